"""Charsets, boilerplate and header fields of raw texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeweave.functions.text import strip, unify_newlines
from tomeweave.vocab import END_MARKERS, START_MARKERS, USABLE_CHARSETS

_ENGLISH = r"(?:Language:[^\n]*English|English[^\n]*Language:)"
# From the start of the text through the whole first line that declares English.
_HEAD = rf"(?s)\A(?:.*?\n)??[^\n]*{_ENGLISH}[^\n]*"


def charset_of(content: Column) -> Column:
    """ascii, UTF-8 or ISO-8859-1, decided from the bytes alone."""
    text = content.cast("string")
    return (
        F.when(~F.is_valid_utf8(text), "ISO-8859-1")
        .when(F.octet_length(content) == F.char_length(text), "ascii")
        .otherwise("UTF-8")
    )


def decode_bytes(content: Column) -> Column:
    utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1"))


def usable_charset(charset: Column, allowed: Sequence[str] = USABLE_CHARSETS) -> Column:
    return charset.isin(list(allowed))


def _line_holding(markers: Sequence[str], whole: bool) -> str:
    any_marker = "|".join(re.escape(m) for m in markers)
    # Only LF ends a line: NEL and the Unicode separators occur inside texts.
    return rf"(?md)^(?:{any_marker})" + (r"[^\n]*(?:\n|\z)" if whole else "")


def strip_boilerplate(
    text: Column,
    start_markers: Sequence[str] = START_MARKERS,
    end_markers: Sequence[str] = END_MARKERS,
) -> Column:
    """What stands after the last start line and before the first end line, stripped."""
    after = F.element_at(F.split(text, _line_holding(start_markers, whole=True)), -1)
    body = F.get(F.split(after, _line_holding(end_markers, whole=False), 2), F.lit(0))
    return strip(body)


def drop_lines(text: Column, markers: Sequence[str]) -> Column:
    """Line-level variant: drop each line that holds one of the markers."""
    any_marker = "|".join(re.escape(m) for m in markers)
    kept = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(any_marker))
    return F.array_join(kept, "\n")


def is_english(raw: Column) -> Column:
    """Some line holds both ``Language:`` and ``English``."""
    return unify_newlines(raw).rlike(_ENGLISH)


def header_of(raw: Column) -> Column:
    """The text through the line that declares English; empty where no line does."""
    return F.regexp_extract(unify_newlines(raw), _HEAD, 0)


def header_field(header: Column, field: str) -> Column:
    """Value on the last header line holding ``field:``, every ``"field: "`` removed."""
    lines = F.regexp_extract_all(header, F.lit(rf"[^\n]*{field}:[^\n]*"), F.lit(0))
    last = F.try_element_at(lines, F.lit(-1))
    return F.coalesce(strip(F.replace(last, F.lit(f"{field}: "), F.lit(""))), F.lit(""))
