"""Measures, tokens and n-grams of a text column.

Every function takes and returns a Column. Nothing leaves the JVM, and per-document results
(term counts included) are computed inside the row, so none of them needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]{2,}"
ALPHABETIC = r"^[\p{L}\s]+$"
SENTENCE = r"[^\s.!?][^.!?]*[.!?]*"

# What Python's str.strip() removes, as far as it occurs in single-byte and UTF-8 texts.
STRIPPED = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` may use it often but compute it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIPPED))


def unify_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _occurrences(text: Column, needle: str) -> Column:
    shrunk = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
    return (shrunk / F.lit(len(needle.encode()))).cast("bigint")


def line_count(text: Column) -> Column:
    """Lines under universal newlines: a closing newline opens no further line, '' has none."""
    breaks = (
        _occurrences(text, "\n") + _occurrences(text, "\r") - _occurrences(text, "\r\n")
    )
    closed = (text == "") | F.endswith(text, F.lit("\n")) | F.endswith(text, F.lit("\r"))
    return breaks + F.when(closed, 0).otherwise(1)


def char_count(text: Column) -> Column:
    """Characters once CR LF has become a single newline."""
    return F.length(text).cast("bigint") - _occurrences(text, "\r\n")


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def alphabetic_only(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(ALPHABETIC))


def without_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(list(stop_words)))


def word_ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens, joined by a blank."""

    def grams(ts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ts) - (n - 1))
        return F.when(
            F.size(ts) >= n,
            F.transform(starts, lambda i: F.array_join(F.slice(ts, i, n), " ")),
        ).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def char_ngrams(text: Column, n: int) -> Column:
    """Overlapping runs of ``n`` characters of the lower-cased text, long blanks made one.

    The pattern looks ahead for the run and consumes one character, so a single linear pass
    yields the run at every position; ``substr`` would walk the UTF-8 bytes from the start for
    each of them.
    """
    flat = F.regexp_replace(F.lower(text), r"\s\s+", " ")
    return F.regexp_extract_all(flat, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))


def run_lengths(items: Column) -> Column:
    """Count equal items of one array: ``array<struct<term, tf>>`` in term order.

    Sorting inside the row replaces ``explode`` + ``groupBy(id, term)`` and its shuffle.
    """

    def from_sorted(s: Column) -> Column:
        n = F.size(s)
        all_positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
            F.array().cast("array<int>")
        )
        starts = F.filter(
            all_positions, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(at, j + 1), n) - p).cast("bigint").alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(items), from_sorted)


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 from the MD5 of a key: the same on every engine and every run."""
    head = F.substring(F.md5(key.cast("string").cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % buckets
