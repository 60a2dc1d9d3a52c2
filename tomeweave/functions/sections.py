"""Cut a section out of a page by its markers."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeweave.functions.text import let


def after_first(text: Column, marker: str) -> Column:
    """What follows the first ``marker``; the text must hold it."""
    return F.substring(text, F.locate(marker, text) + len(marker), F.length(text))


def between(text: Column, opening: str, closing: str) -> Column:
    """Text from the first ``opening`` to the next ``closing``; '' without the opening."""

    def cut(t: Column) -> Column:
        rest = F.when(F.contains(t, F.lit(opening)), after_first(t, opening)).otherwise("")
        return F.substring_index(rest, closing, 1)

    return let(text, cut)


def extract_section(
    page: Column,
    start: str,
    end: str,
    on_missing: Literal["empty", "whole"] = "empty",
    by_line: bool = False,
) -> Column:
    """Text between two markers.

    By offset, the section runs from marker to marker. By line, the start marker's line is
    left out and the end marker's line is the last one of the section.
    """

    def next_line(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("\n")), after_first(text, "\n")).otherwise("")

    def opened(p: Column) -> Column:
        after = after_first(p, start)
        body = let(after, next_line) if by_line else after
        missing = F.lit("") if on_missing == "empty" else p
        return F.when(F.contains(p, F.lit(start)), body).otherwise(missing)

    def closed(body: Column) -> Column:
        head = F.substring_index(body, end, 1)
        if not by_line:
            return head
        tail = F.substring_index(after_first(body, end), "\n", 1)
        return F.when(F.contains(body, F.lit(end)), F.concat(head, F.lit(end), tail)).otherwise(body)

    # Bound step by step: each holds most of the page, and is used several times.
    return let(let(page, opened), closed)
