"""File names, paths and URLs as columns."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeweave.functions.text import strip
from tomeweave.vocab import (
    NAME_DELIMITER,
    NAME_PART_LIMIT,
    NAME_SUFFIX,
    PROCESSED_PREFIX,
    SKIPPED_PREFIX,
)

# Characters a file name may not hold. The backslash is allowed.
FORBIDDEN = r'[<>:"/|?*]'


def _join_parts(title: Column, author: Column) -> Column:
    return F.concat(title, F.lit(NAME_DELIMITER), author, F.lit(NAME_SUFFIX))


def pack_name(title: Column, author: Column) -> Column:
    """Cut each part, then drop slashes, then join."""

    def part(c: Column) -> Column:
        return F.replace(F.substring(c, 1, NAME_PART_LIMIT), F.lit("/"), F.lit(""))

    return _join_parts(part(title), part(author))


def sanitize_part(part: Column) -> Column:
    return F.regexp_replace(F.substring(part, 1, NAME_PART_LIMIT), FORBIDDEN, "")


def sanitize_name(title: Column, author: Column) -> Column:
    return _join_parts(sanitize_part(title), sanitize_part(author))


def title_of(name: Column) -> Column:
    return strip(F.substring_index(name, NAME_DELIMITER, 1))


def author_of(name: Column) -> Column:
    """NULL where the name holds no delimiter."""
    part = F.get(F.split(name, NAME_DELIMITER), F.lit(1))
    return strip(F.replace(part, F.lit(NAME_SUFFIX), F.lit("")))


def escape_blanks(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("%20"))


def search_url(base: str, title: Column, author: Column) -> Column:
    return F.concat(
        F.lit(f"{base}?q=intitle:"), escape_blanks(title), F.lit("+inauthor:"), escape_blanks(author)
    )


def book_page_url(base: str, isbn: Column) -> Column:
    return F.concat(F.lit(f"{base}/book/isbn/"), isbn)


def category_page_url(base: str, category: Column, page: Column) -> Column:
    return F.concat(
        F.lit(f"{base}/categories/"), category, F.lit("/"), page.cast("string"), F.lit("/en")
    )


def download_url(base: str, book_id: Column) -> Column:
    return F.concat(
        F.lit(f"{base}/send/1:text:.txt:text/"), book_id, F.lit("/"), book_id, F.lit(NAME_SUFFIX)
    )


def info_url(base: str, book_id: Column) -> Column:
    return F.concat(F.lit(f"{base}/titles/"), book_id, F.lit(".html"))


def rebase_path(path: Column, directory: str, separator: str = "\\") -> Column:
    """Replace everything up to the last separator by ``directory``."""
    return F.concat(F.lit(directory), F.substring_index(path, separator, -1))


def file_name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_name_of(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def parent_path_of(path: Column) -> Column:
    cut = F.length(path) - F.length(file_name_of(path)) - 1
    return F.substring(path, F.lit(1), cut)


def relative_to(path: Column, root: str) -> Column:
    """What follows the root in a path, whatever scheme and host either is written with."""
    bare = urlsplit(root).path.rstrip("/")
    return F.substring(path, F.locate(bare, path) + len(bare), F.length(path))


def strip_prefix(name: Column, prefix: str) -> Column:
    return F.when(
        F.startswith(name, F.lit(prefix)), F.substring(name, F.lit(len(prefix) + 1), F.length(name))
    ).otherwise(name)


def status_of_name(name: Column) -> Column:
    """A processed or skipped mark counts wherever it stands in the name."""
    return (
        F.when(F.contains(name, F.lit(PROCESSED_PREFIX)), "processed")
        .when(F.contains(name, F.lit(SKIPPED_PREFIX)), "skipped")
        .otherwise("pending")
    )


def is_system_file(name: Column, markers: tuple[str, ...] = (".DS",)) -> Column:
    hit = F.lit(False)
    for marker in markers:
        hit = hit | F.contains(name, F.lit(marker))
    return hit
