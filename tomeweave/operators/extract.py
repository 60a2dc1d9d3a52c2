"""Rows out of stored HTML pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave import vocab
from tomeweave.functions.names import category_page_url, download_url, info_url
from tomeweave.functions.sections import after_first, between, extract_section
from tomeweave.functions.text import let, strip, unify_newlines


def _named_counts(
    section: Column,
    name_line: str,
    name_of: Callable[[Column], Column],
    is_count: Callable[[Column], Column],
    count_of: Callable[[Column], Column],
    on_name_line: bool = False,
) -> Column:
    """``array<struct<label, pos, n>>``: each name line with the last count line below it.

    ``on_name_line`` lets the name's own line be a count line as well.

    Cutting the section before every name line carries the name forward without a window.
    A name without a count gets 0; of a repeated name the last place stays; counts that
    precede every name are dropped.
    """
    marker = re.escape(name_line)
    chunks = F.filter(
        F.split(section, rf"(?md)^(?=[^\n]*{marker})"), lambda c: F.contains(c, F.lit(name_line))
    )

    def entry(chunk: Column, pos: Column) -> Column:
        counts = F.filter(F.slice(F.split(chunk, "\n"), 1 if on_name_line else 2, F.length(chunk)), is_count)
        n = let(
            counts,
            lambda cs: F.when(F.size(cs) > 0, count_of(F.element_at(cs, -1))).otherwise(
                F.lit(0).cast("bigint")
            ),
        )
        name = name_of(F.substring_index(chunk, "\n", 1))
        return F.struct(name.alias("label"), pos.cast("bigint").alias("pos"), n.alias("n"))

    def last_places(s: Column) -> Column:
        # A label missing beyond the end compares as NULL, hence the null-safe form.
        return F.filter(s, lambda e, i: ~F.get(s, i + 1)["label"].eqNullSafe(e["label"]))

    return let(F.array_sort(F.transform(chunks, entry)), last_places)


def tag_counts(pages: DataFrame, keep: Sequence[str], html: str = "html") -> DataFrame:
    """Tags on a book's page and how many readers gave them: ``keep..., label, pos, n``."""
    page = unify_newlines(F.col(html))
    section = extract_section(page, vocab.TAG_SECTION_START, vocab.TAG_SECTION_END, by_line=True)
    # Lines of a tag below another tag count for nothing, not even as a name.
    lines = F.filter(
        F.split(section, "\n"),
        lambda x: ~(
            F.contains(x, F.lit(vocab.TAG_NAME_LINE)) & F.contains(x, F.lit(vocab.TAG_SUBTAG))
        ),
    )
    found = _named_counts(
        F.array_join(lines, "\n"),
        vocab.TAG_NAME_LINE,
        lambda line: between(line, vocab.TAG_NAME_BEFORE, vocab.TAG_NAME_AFTER),
        lambda line: F.contains(line, F.lit(vocab.TAG_COUNT_LINE)),
        lambda line: F.regexp_extract(line, r'^[^"]*"([^ ]*) ', 1).try_cast("bigint"),
        on_name_line=True,
    )
    return pages.select(*keep, F.inline(found))


def listing_counts(pages: DataFrame, keep: Sequence[str], html: str = "html") -> DataFrame:
    """Tags on a listing page and their number of books: ``keep..., label, pos, n``."""
    section = extract_section(
        unify_newlines(F.col(html)),
        vocab.LISTING_SECTION_START,
        vocab.LISTING_SECTION_END,
        on_missing="whole",
        by_line=True,
    )
    found = _named_counts(
        section,
        vocab.LISTING_NAME_LINE,
        lambda line: between(line, ">", "<"),
        lambda line: line.rlike(r"^\s*[0-9]"),
        lambda line: F.replace(
            F.regexp_extract(line, r"^\s*([0-9,]+) b", 1), F.lit(","), F.lit("")
        ).try_cast("bigint"),
    )
    return pages.select(*keep, F.inline(found))


def category_entries(
    pages: DataFrame, keep: Sequence[str], base: str, html: str = "html"
) -> DataFrame:
    """Books on a category page: ``keep..., id, title, author, dl_url, info_url``."""
    section = extract_section(
        unify_newlines(F.col(html)),
        vocab.CATEGORY_SECTION_START,
        vocab.CATEGORY_SECTION_END,
        by_line=True,
    )
    lines = F.filter(
        F.split(section, "\n"), lambda x: F.contains(x, F.lit(vocab.CATEGORY_ENTRY))
    )
    line = F.col("_line")
    entry = F.col("_entry")
    book_id = F.col("id")
    fields = (
        pages.select(*keep, F.explode(lines).alias("_line"))
        .withColumn("_entry", after_first(line, vocab.CATEGORY_ENTRY))
        .select(
            *keep,
            F.substring_index(entry, ".html", 1).alias("id"),
            between(entry, '.html">', "</a>").alias("title"),
            strip(F.substring_index(line, "<br />", -1)).alias("author"),
        )
    )
    return fields.select(
        "*", download_url(base, book_id).alias("dl_url"), info_url(base, book_id).alias("info_url")
    )


def section_entries(
    pages: DataFrame,
    keep: Sequence[str],
    start: str,
    end: str,
    pattern: str,
    fields: Mapping[str, int],
    html: str = "html",
) -> DataFrame:
    """Every match of ``pattern`` in a page's section; ``fields`` names its groups."""
    section = extract_section(F.col(html), start, end)
    matches = F.regexp_extract_all(section, F.lit(pattern), F.lit(0))
    return pages.select(*keep, F.explode(matches).alias("_entry")).select(
        *keep,
        *[F.regexp_extract("_entry", pattern, group).alias(name) for name, group in fields.items()],
    )


def category_pages(
    categories: DataFrame, base: str, category: str = "category", pages: str = "pages"
) -> DataFrame:
    """Each category times its pages 1..n, with the page's URL."""
    numbered = categories.withColumn(
        "page",
        F.explode(
            F.when(F.col(pages) >= 1, F.sequence(F.lit(1).cast("bigint"), F.col(pages).cast("bigint")))
        ),
    )
    return numbered.drop(pages).withColumn(
        "url", category_page_url(base, F.col(category), F.col("page"))
    )
