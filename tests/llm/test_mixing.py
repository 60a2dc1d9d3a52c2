"""Targets by hand, balance of the cube sample, and copies of odd rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tomeweave.llm import mixing
from tomeweave.llm.common import table, word_count

SCHEMA = "doc_id LONG, text STRING, source STRING, size STRING, copies INT, _no INT"


def water(sizes: dict, share=1.5, most=2.0):
    """Shares by weight, the excess of capped sources reshared until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "é": 5, "Z": 70, None: 300, "": 1}, {"only": 7}, {"x": 0, "y": 4}, {"z": 0}, {}):
        df = spark.createDataFrame(list(sizes.items()), "source STRING, source_size LONG")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = water(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        assert got == pytest.approx(want)


def test_word_count(spark):
    texts = ["", None, " ", "a", "a b", "\ta\x0bb\x0c c\r\n", "é\xa0b c", "x" * 50_000 + " y"]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    got = [r[0] for r in df.select(word_count(df["text"])).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_flight_keeps_the_balance(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(1, 3000, 700).astype(float)
    p = rng.uniform(0.05, 0.95, 700)
    tokens, number = p @ s, p.sum()
    q = p.copy()
    mixing.flight(q, s, rng, 2)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q @ s == pytest.approx(tokens) and q.sum() == pytest.approx(number)
    mixing.landing(q, s)
    assert set(q.tolist()) <= {0.0, 1.0}


def test_inclusion_probabilities_hold():
    s = np.array([5.0, 9, 2, 14, 7, 7, 3, 30, 11, 6] * 4)
    hits = np.zeros(40)
    for seed in range(600):
        p = np.full(40, 0.3)
        mixing.flight(p, s, np.random.default_rng(seed), 2)
        hits += p
    assert abs(hits / 600 - 0.3).max() < 0.09


def test_query_is_near_its_targets(spark, small):
    rows = mixing.query(spark, small).collect()
    assert len(rows) == 200
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    assert target == pytest.approx(water(sizes))
    assert all(abs(taken[s] - target[s]) <= 0.25 * target[s] for s in target)
    assert abs(sum(taken.values()) - sum(target.values())) < 0.02 * sum(target.values())
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(table(spark, small, "documents").repartition(5)).selectExpr("doc_id", "size * copies taken").collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)  # several rounds of blocks
    rows = [(i, "w " * (1 + i % 9), "abc"[i % 3], "s", 1, 2) for i in range(150)]
    rows += [(500, "same text", "a", "s", 1, 2)] * 5 + [(501, None, None, "s", 1, 2), (None, "n u l l", None, "s", 1, 2), (502, "", "z", "s", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == len(rows) and all(0 <= r["copies"] <= 2 for r in plan)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    got, want = Counter(r["doc_id"] for r in mixed.collect()), Counter()
    for r in plan:
        want[r["doc_id"]] += r["copies"]
    assert got == +want
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mix_plan(df.limit(0)).collect() == []
