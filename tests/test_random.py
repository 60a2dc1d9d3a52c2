"""Column functions against plain Python on random texts."""

from __future__ import annotations

import io
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tomeweave.functions import clean, sections, text
from tomeweave.operators import profile, terms
from tomeweave.vocab import END_MARKERS, START_MARKERS

PIECES = [
    "\n", "\r\n", "\r", " ", "a", "bc", "é", "ß", "😀", ".", "!", "?", "_x1", "Title: ", "Author:", "Language:",
    " English", "*** START", "***END", "\n*** START x\n", "\n*** END", "\nLanguage: English\n", "<s>", "</e>",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(600)]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4).cache()


def computed(frame, column):
    return [r[1] for r in frame.select("i", column.alias("x")).orderBy("i").collect()]


def unified(value):
    return value.replace("\r\n", "\n").replace("\r", "\n")


def test_lines_and_characters(frame, texts):
    body = F.col("text")
    assert computed(frame, text.line_count(body)) == [len(list(io.StringIO(t, newline=None))) for t in texts]
    assert computed(frame, text.char_count(body)) == [len(unified(t)) for t in texts]


def test_header(frame, texts):
    def field(value, name):
        lines = unified(value).split("\n")
        english = [k for k, line in enumerate(lines) if "Language:" in line and "English" in line]
        named = [line for line in lines[: english[0] + 1] if f"{name}:" in line] if english else []
        return named[-1].replace(f"{name}: ", "").strip() if named else ""

    body = F.col("text")
    expected = [any("Language:" in x and "English" in x for x in unified(t).split("\n")) for t in texts]
    assert computed(frame, clean.is_english(body)) == expected and 50 < sum(expected) < 550
    for name in ("Title", "Author"):
        got = computed(frame, clean.header_field(clean.header_of(body), name))
        assert got == [field(t, name) for t in texts]


def test_boilerplate(frame, texts):
    def body_of(value):
        lines = unified(value).split("\n")
        starts = [k for k, line in enumerate(lines) if line.startswith(START_MARKERS)]
        rest = lines[starts[-1] + 1 :] if starts else lines
        ends = [k for k, line in enumerate(rest) if line.startswith(END_MARKERS)]
        return "\n".join(rest[: ends[0]] if ends else rest).strip()

    got = computed(frame, clean.strip_boilerplate(text.unify_newlines(F.col("text"))))
    assert got == [body_of(t) for t in texts]


@pytest.mark.parametrize("on_missing", ["empty", "whole"])
def test_sections_by_line(frame, texts, on_missing):
    def section(value):
        lines = value.split("\n")
        first = next((k for k, line in enumerate(lines) if "<s>" in line), None)
        if first is None and on_missing == "empty":
            return ""
        rest = lines if first is None else lines[first + 1 :]
        last = next((k for k, line in enumerate(rest) if "</e>" in line), len(rest))
        return "\n".join(rest[: last + 1])

    got = computed(frame, sections.extract_section(F.col("text"), "<s>", "</e>", on_missing, by_line=True))
    assert got == [section(t) for t in texts]


def test_sentences(frame, texts):
    def stats(value):
        found = [s.group() for s in re.finditer(r"[^ \t\n\x0b\x0c\r.!?][^.!?]*[.!?]*", value)]
        return (len(value), len(found), pytest.approx(sum(map(len, found)) / len(found)) if found else None)

    got = profile.document_stats(frame.orderBy("i")).drop("i", "text").collect()
    assert [tuple(r) for r in got] == [stats(t) for t in texts]


def test_term_counts(frame, texts):
    got = {(r["i"], r["term"]): r["tf"] for r in terms.term_counts(frame, ["i"]).collect()}
    want = {(i, w): n for i, t in enumerate(texts) for w, n in Counter(re.findall(r"\w{2,}", t.lower())).items()}
    assert got == want


@pytest.mark.parametrize("n", [2, 3, 4])
def test_ngrams(frame, texts, n):
    def runs(items, glue):
        return [glue.join(items[k : k + n]) for k in range(len(items) - n + 1)]

    body = F.col("text")
    flat = [re.sub(r"[ \t\n\x0b\x0c\r]{2,}", " ", t.lower()) for t in texts]
    assert computed(frame, text.char_ngrams(body, n)) == [runs(list(t), "") for t in flat]
    words = [re.findall(r"\w{2,}", t.lower()) for t in texts]
    assert computed(frame, text.word_ngrams(text.word_tokens(body), n)) == [runs(w, " ") for w in words]
