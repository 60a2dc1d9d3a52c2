"""Label sets, tag rules and page markers.

Everything in this module is a constant that results depend on; nothing here is logic.
"""

from __future__ import annotations

# The seven shelf labels of the corpus.
SHELVES = (
    "Adventure",
    "Biography",
    "History",
    "Mystery-Horror",
    "Poetry",
    "Romance",
    "Science Fiction",
)

# Category code and number of listing pages per shelf.
SHELF_PAGES = (
    ("Adventure", "ADV", 90),
    ("Biography", "BIO", 88),
    ("History", "HIS", 160),
    ("Mystery-Horror", "MYS", 43),
    ("Poetry", "POE", 71),
    ("Romance", "ROM", 80),
    ("Science Fiction", "SFC", 69),
)

# Tags kept under their own name.
MAIN_TAGS = (
    "fantasy",
    "romance",
    "mystery-horror",
    "poetry",
    "science-fiction",
    "historical",
    "general-fiction",
    "history",
    "biography",
    "non-fiction",
)

# Tag -> main tag it is folded into.
FOLDED_TAGS = {
    "mystery": "mystery-horror",
    "horror": "mystery-horror",
    "thriller": "mystery-horror",
    "contemporary-romance": "romance",
    "urban-fantasy": "fantasy",
    "crime": "mystery-horror",
    "erotica": "romance",
    "suspense": "mystery-horror",
    "paranormal-romance": "romance",
    "historical-romance": "romance",
    "magic": "fantasy",
    "vampires": "fantasy",
    "supernatural": "fantasy",
    "memoir": "biography",
    "mystery-thriller": "mystery-horror",
    "love": "romance",
    "bdsm": "romance",
    "mythology": "fantasy",
    "romantic-suspense": "romance",
    "science-fiction-fantasy": "science-fiction",
    "erotic-romance": "romance",
    "detective": "mystery-horror",
    "paranormal": "mystery-horror",
}

# Tags whose target depends on fiction / non-fiction.
HISTORY_TAGS = ("historical-fiction", "history", "historical", "war", "military", "roman")
HISTORY_TARGETS = {"fiction": "historical-fiction", "non-fiction": "history"}
OTHER_TAGS = (
    "adventure",
    "humor",
    "philosophy",
    "science",
    "drama",
    "psychology",
    "religion",
    "politics",
    "action",
    "travel",
    "comedy",
    "self-help",
)
OTHER_TARGETS = {"fiction": "general-fiction", "non-fiction": "other"}

# File-name conventions.
NAME_DELIMITER = "%%%"
NAME_SUFFIX = ".txt"
NAME_PART_LIMIT = 100
PROCESSED_PREFIX = "$$$"
SKIPPED_PREFIX = "~~~"

# Charsets a text may have to be kept.
USABLE_CHARSETS = ("ascii", "ISO-8859-2", "ISO-8859-1", "UTF-8")

# Lines that open and close the licence parts of a text.
START_MARKERS = ("*** START", "***START", "*END*THE SMALL PRINT")
END_MARKERS = ("*** END", "***END")

# Markers on a book's page of tags.
TAG_SECTION_START = '<a href="/work/shelves/'
TAG_NAME_LINE = '<a class="actionLinkLite bookPageGenreLink"'
TAG_NAME_BEFORE = "/genres/"
TAG_NAME_AFTER = '">'
TAG_SUBTAG = "&gt"
TAG_COUNT_LINE = '<a title="'
TAG_SECTION_END = '<a class="actionLink right bookPageGenreLink__seeMoreLink"'

# Markers on a page of the tag listing.
LISTING_SECTION_START = '<option value="top-level" >'
LISTING_NAME_LINE = '<a class="mediumText actionLinkLite" href="/genres/'
LISTING_SECTION_END = '<div class="moreLink">'

# Markers on a category page of books.
CATEGORY_SECTION_START = '<div class="grid_13 omega">'
CATEGORY_ENTRY = "/titles/"
CATEGORY_SECTION_END = '<div class="grid_6">'
