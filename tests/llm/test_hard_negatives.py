"""Hard negatives against brute force, over one block and over many."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeweave.llm import hard_negatives

SCHEMA = "vec_id LONG, embedding ARRAY<DOUBLE>, label INT, rank INT, score STRING, row STRING, block INT"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 0, "clash", "x", 1) for i, v, label in rows], SCHEMA).repartition(3)


def odd_rows(rng, n=300, dims=11):
    """Clusters with wrong labels, a hot vector, ties, short, zero, NULL and non-finite rows."""
    centres = rng.normal(size=(6, dims))
    rows = [(i, (centres[i % 6] + 0.5 * rng.normal(size=dims)).tolist(), i % 6 if i % 5 else (i + 1) % 6) for i in range(n)]
    rows += [(1000 + i, centres[0].tolist(), i % 2) for i in range(120)]
    return rows + [
        (2000, None, 1), (2005, [0.0] * dims, 1), (2010, [1.0, None] + [0.0] * (dims - 2), 1), (2015, [float("nan")] * dims, 1),
        (2020, [float("inf")] * dims, 2), (2025, [3.0, 4.0], 2), (2030, [], 2), (2035, centres[1].tolist(), None),
        (None, [1.0] * dims, 1), (2040, [-1.0] * dims, 77), (10, rows[10][1], rows[10][2]), (11, rows[11][1], rows[11][2]),
    ]


def brute(rows, every, dims, positives=5, negatives=10):
    whole = [
        (i, np.floor(256 * np.array(v + [0.0] * (dims - len(v)))), label) for i, v, label in rows
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for a, q, label in whole:
        if a % every:
            continue
        scored = sorted((-int(q @ v), i, other == label) for i, v, other in whole if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            inside = [x for x in scored if not x[2] and -30 * s <= -100 * x[0] <= -90 * s][:negatives]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, every):
    found = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, F.col("label"))
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("size", [4096, 16])
def test_equals_brute_force(spark, monkeypatch, size):
    """Also where most rows lie outside the slice, windows stay unfilled and rows repeat."""
    monkeypatch.setattr(hard_negatives, "ROWS", size)
    monkeypatch.setattr(hard_negatives, "ANCHORS", size)
    rows = odd_rows(np.random.default_rng(1))
    got = mined(spark, rows, 5)
    assert got == brute(rows, 5, 11) and len(got) > 1000


def test_few_and_no_rows(spark):
    rows = odd_rows(np.random.default_rng(2))
    assert mined(spark, rows[:4], 2) == brute(rows[:4], 2, 11)
    assert mined(spark, [], 5) == []
    assert mined(spark, rows[:4], 1000000) == brute(rows[:4], 1000000, 11)


def test_windows_are_whole_hundredths(spark):
    """Bounds count, negative and zero scores open no or a single-point window."""
    rows = [(0, [1.0, 0.0], 0), (1, [10 / 256, 0.0], 0), (2, [3 / 256, 0.0], 1), (3, [9 / 256, 0.0], 1),
            (4, [2 / 256, 0.0], 1), (6, [0.0, 5.0], 1), (8, [-1.0, 0.0], 0), (9, [0.0, 1.0], 0), (12, [10 / 256, 1.0], 1)]
    got = mined(spark, rows, 100)
    assert got == brute(rows, 100, 2)
    assert {(p, n) for _, p, _, n, _, _ in got} == {(1, 2), (1, 3), (9, 6)}


def test_sums_beyond_exact_doubles(spark):
    rows = [(0, [2.0**24, 3.0], 0), (1, [2.0**20, 7.0], 0), (2, [2.0**19, 5.0], 1), (3, [2.0**18, -5.0], 1)]
    whole = {i: [int(256 * x) for x in v] for i, v, _ in rows}
    score = {i: sum(a * b for a, b in zip(whole[0], whole[i])) for i in whole}
    got = mined(spark, rows, 100)
    assert got == [(0, 1, 1, 2, score[1], score[2])] and 30 * score[1] > 100 * score[3]


@pytest.mark.parametrize("least", [float(hard_negatives.NONE), 0.0, 2e5, 6e5, 1e9])
def test_index_loses_nothing(least):
    rng = np.random.default_rng(3)
    scale = np.geomspace(3, 0.1, 21)
    rows, asked = (np.floor(256 * rng.normal(size=(n, 21)) * scale) for n in (400, 30))
    tails = hard_negatives._tails(asked)
    index = hard_negatives.Index(np.arange(400), np.zeros(400, int), rows, tails.max(axis=0), least)
    for q, t in zip(asked, tails):
        kept = index.candidates(q, t, least)
        assert set(np.flatnonzero(rows @ q >= least)) <= set(index.ids[kept].tolist())
        assert len(kept) == len(set(kept.tolist()))
    if least == 1e9:
        assert sum(index.listed) == 0
    if least == 6e5:
        assert 0 < sum(index.listed) < 400 * len(index.listed)  # some postings are left out


def test_thresholds_are_lowered(spark, monkeypatch):
    """A window that the first threshold leaves unfilled is joined again."""
    monkeypatch.setattr(hard_negatives, "ROWS", 8)
    asked = []
    search = hard_negatives.Blocks.search

    def noted(self, windows, first, k, same):
        asked.append((first, same, windows.count()))
        return search(self, windows, first, k, same)

    monkeypatch.setattr(hard_negatives.Blocks, "search", noted)
    rows = odd_rows(np.random.default_rng(4))
    assert mined(spark, rows, 5) == brute(rows, 5, 11)
    for same in (True, False):
        rounds = [n for first, s, n in asked if s == same and not first]
        assert len(rounds) == 2 and 0 < rounds[1] < rounds[0]
