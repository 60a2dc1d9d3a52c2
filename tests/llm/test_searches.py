"""Exact products and tree neighbours against brute force."""

from __future__ import annotations

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeweave.llm import exact_search, neighbour_tree

SCHEMA = "vec_id LONG, embedding ARRAY<DOUBLE>, score STRING, rank INT"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", 0) for i, v in vectors], SCHEMA).repartition(3)


def odd_vectors(rng, dims=6, n=260):
    """Rows of many lengths, a hot vector, ties, short, zero, NULL and non-finite ones."""
    rows = [(i, (rng.normal(size=dims) * 10 ** rng.uniform(-1, 1)).tolist()) for i in range(n)]
    rows += [(1000 + i, [0.5] * dims) for i in range(120)]
    rows += [(2000, None), (2001, [0.0] * dims), (2002, [1.0, None] + [0.0] * (dims - 2)),
             (2003, [float("nan")] * dims), (2004, [float("inf")] * dims), (2005, [3.0, 4.0]), (2006, [])]
    return rows + [(None, [1.0] * dims), (7, rows[7][1])]


def whole(rows, dims, zero):
    out = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = np.array(v + [0.0] * (dims - len(v)))
        if zero or v.any():
            out.append((i, v))
    return out


def test_products_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = odd_vectors(rng)
    for part in (rows, [(i, v) for i, v in rows if i is not None and i < 5], []):
        got = {}
        for r in exact_search.top_products(frame(spark, part), F.col("vec_id") % 5 == 0).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        kept = [(i, np.floor(1024 * v)) for i, v in whole(part, 6, True)]
        for i, q in kept:
            if i % 5:
                continue
            scores = sorted((-int(q @ v), j) for j, v in kept if j != i)[:10]
            assert sorted(got.get(i, [])) == [(k, j, -s) for k, (s, j) in enumerate(scores, 1)]


def test_products_beyond_exact_doubles(spark):
    rows = [(0, [2.0**40, 3.0]), (1, [2.0**30, 5.0]), (2, [2.0**30, 7.0]), (3, [2.0**60, 0.0])]
    got = exact_search.top_products(frame(spark, rows), F.col("vec_id") == 0).collect()
    want = {j: min(2**63 - 1, sum(int(1024 * a) * int(1024 * b) for a, b in zip(rows[0][1], v))) for j, v in rows[1:]}
    assert {r["vec_id"]: r["score"] for r in got} == want


@pytest.mark.parametrize("bound", [-5.0, 0.0, 3e5, 8e5])
def test_buckets_lose_nothing(bound):
    rng = np.random.default_rng(2)
    rows = np.floor(1024 * rng.normal(size=(500, 8)))
    lengths = np.linalg.norm(rows, axis=1)
    bucket = exact_search.Bucket(np.arange(500), rows, lengths)
    for q in rows[:40]:
        kept = set(bucket.ids[bucket.candidates(q, float(np.linalg.norm(q)), bound)].tolist())
        assert {i for i in range(500) if rows[i] @ q >= bound} <= kept


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(3000)]
    got = {}
    for r in neighbour_tree.neighbours(frame(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    matrix, hits = np.array([v for _, v in rows]), 0
    for i in range(0, 3000, 50):
        away = np.sqrt(((matrix - matrix[i]) ** 2).sum(axis=1))
        true = [j for j in np.lexsort((np.arange(3000), away)) if j != i][:10]
        found = sorted(got[i])
        assert [k for k, _, _ in found] == list(range(1, 11))
        assert all(abs(s - away[j]) < 1e-12 for _, j, s in found)
        assert [(s, j) for _, j, s in found] == sorted((s, j) for _, j, s in found)
        hits += len({j for _, j, _ in found} & set(true))
    assert hits / 600 >= 0.9


def test_calibrated_recall_is_not_lowered():
    """A query's visits are those that find 97 of 100 true neighbours."""
    assert inspect.signature(neighbour_tree.neighbours).parameters["recall"].default == 0.97


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = odd_vectors(rng)
    found = neighbour_tree.neighbours(frame(spark, rows), F.col("vec_id") % 5 == 0, recall=1.0).collect()
    kept = whole(rows, 6, False)
    ids = {i for i, _ in kept}
    assert {r["query_id"] for r in found} == {i for i in ids if i % 5 == 0}
    assert all(r["vec_id"] in ids and r["vec_id"] != r["query_id"] for r in found)
    hot = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 1050)
    assert hot == [(k + 1, 1000 + k, 0.0) for k in range(10)]
    assert neighbour_tree.neighbours(frame(spark, []), F.col("vec_id") >= 0).collect() == []
    few = neighbour_tree.neighbours(frame(spark, rows[:3]), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


def test_tree_visits_every_leaf_once():
    rng = np.random.default_rng(5)
    tree = neighbour_tree.Tree(rng.normal(size=(2000, 5)), 20000)
    order = list(tree.visit(rng.normal(size=5)))
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 30
