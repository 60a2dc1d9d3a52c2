"""The shingle join against all pairs, and its parts."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pytest

from tomeweave.llm import shingle_join
from tomeweave.llm.common import table
from tomeweave.llm.components import components
from tomeweave.llm.shingles import shingle_sets


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    """``doc_id, n_shingles, component_id`` by all pairs; NULL ids are never the least."""
    sets = [shingles_of(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d is not None, d or 0), len(s), least.get(find(i), None) or 0) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def check(spark, docs):
    df = spark.createDataFrame([(d, t, 7, "clash") for d, t in docs], "doc_id LONG, text STRING, n INT, sig STRING").repartition(3)
    got = shingle_join.near_copies(df).collect()
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_shingles"], r["component_id"] or 0) for r in got)
    assert rows == brute(docs)


def family(rng, vocabulary, size, copies, edits):
    base = [rng.choice(vocabulary) for _ in range(size)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(w)
    return out


@pytest.mark.parametrize(("leaf", "block"), [(16, 1024), (2, 8)])
def test_equals_all_pairs(spark, monkeypatch, leaf, block):
    """Also with tiny leaves and blocks, so that large trees are probed, cut and left over."""
    monkeypatch.setattr(shingle_join, "LEAF", leaf)
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(w) for w in family(rng, vocabulary, 120, 40, 6) + family(rng, vocabulary, 60, 25, 3) + family(rng, vocabulary, 30, 20, 2)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    for n in (5, 10, 14, 16, 18, 20, 25, 40, 60):
        texts += [" ".join([*passage, *(rng.choice(vocabulary) for _ in range(n))]) for _ in range(5)]
    texts += ["a b c", "A  b\tc", "a b", "", None, "   ", "one two three four five", "One two three four five", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_odd_rows(spark):
    check(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, "x y"), (0, None), (2, "w " * 40_000), (3, "w " * 30_000), (4, " ".join(map(str, range(20_000))))])
    check(spark, [])


def test_every_link_shares_a_prefix_shingle():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.choice(400, rng.integers(1, 60), replace=False)
        b = np.union1d(a[rng.random(len(a)) < 0.9], rng.choice(400, rng.integers(0, 8), replace=False))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * len(np.union1d(a, b)):
            pa, pb = (set(np.sort(x)[: shingle_join.prefix_length(len(x))].tolist()) for x in (a, b))
            assert pa & pb


def test_tree_finds_all_within_bounds():
    rng = np.random.default_rng(4)
    rows = rng.poisson(rng.choice([1, 4, 5], (300, 1)), (300, 128)).astype(np.uint16)
    rows[100:150] = rows[0] + (rng.random((50, 128)) < 0.05)
    sizes, classes = rows.sum(axis=1).astype(int), np.arange(300) // 40
    tree = shingle_join.CountTree(rows, sizes, classes)
    for q in range(0, 300, 7):
        shared = np.minimum(rows, rows[q]).sum(axis=1)
        need = [shingle_join.overlap_needed(int(s), int(sizes[q])) for s in sizes]
        want = {i for i in range(300) if shared[i] >= need[i] and classes[i] != classes[q]}
        assert set(tree.search(rows[q], int(sizes[q]), int(classes[q])).tolist()) == want


def test_no_link_is_lost_between_resolutions():
    """Also where a group's count does not fit its byte."""
    rng = np.random.default_rng(6)
    universe = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    universe[:900] >>= np.uint64(20)  # many in the first group
    sets = []
    for _ in range(60):
        base = rng.choice(universe, rng.integers(3, 2500), replace=False)
        sets += [np.unique(base[rng.random(len(base)) < keep]) for keep in (1, 0.95, 0.85, 0.78)]
    sets = [s for s in sets if len(s)]
    sizes = np.array([len(s) for s in sets])
    packed = [shingle_join.points(s) for s in sets]
    trees = shingle_join.Trees(packed, sizes, np.arange(len(sets)))
    assert len({len(p) for p in packed}) >= 3
    for i, a in enumerate(sets):
        links = {j for j, b in enumerate(sets) if j != i and shingle_join.linked(a, b)}
        assert links <= set(trees.search(packed[i], len(a), i).tolist())


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_blocks_of_neighbouring_resolutions_meet_in_both_orders(n):
    words = [f"w{i}" for i in range(n + 20)]
    texts = [" ".join(words[: n - 8 + 4]), " ".join(words[: n + 8 + 4])]
    sets = shingle_sets(texts)
    assert len(sets[0]) <= n < len(sets[1]) and shingle_join.linked(*sets)

    def block(k):
        return pd.DataFrame({"sig": [k], "n": [len(sets[k])], "point": [shingle_join.points(sets[k])], "class": [k], "text": [texts[k]]})

    for a, b in ((0, 1), (1, 0)):
        for meet in (shingle_join._promising, shingle_join._joined):
            assert meet(block(a), block(b)).to_numpy().tolist() == [[a, b]]


def test_hashes_tell_shingles_apart(spark, small):
    texts = [r["text"] for r in table(spark, small, "documents").collect()]
    sets = shingle_sets(texts)
    true = [shingles_of(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in true]
    assert len(np.unique(np.concatenate(sets))) == len(set().union(*true))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (2000, 1999), (1999, 2000)]
    edges += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(150)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted((x, find(x)) for x in nodes)
    assert components(spark.createDataFrame([], "a LONG, b LONG")).collect() == []


def test_stage_keeps_one_of_each_group(spark, small):
    docs = table(spark, small, "documents")
    left = shingle_join.kept(docs)
    found = shingle_join.query(spark, small).collect()
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in found if r["doc_id"] == r["component_id"]}


def test_stage_keeps_one_row_of_repeated_and_missing_ids(spark):
    a, near, other = "a b c d e f g h", "A b c d e f g h", "one two three four five six"
    rows = [(1, a), (1, a), (2, near), (2, other), (None, "x y z"), (None, "x y z"), (None, other), (7, None), (7, None), (8, ""), (3, "alone in here"), (9, "p q"), (9, "P q")]
    df = spark.createDataFrame([(d, t, "s", "clash") for d, t in rows], "doc_id LONG, text STRING, source STRING, th STRING").repartition(3)
    left = shingle_join.kept(df)
    assert left.columns == df.columns and left.schema.simpleString() == df.schema.simpleString()
    got = sorted((r["doc_id"] or 0, (r["text"] or "").lower(), r["th"]) for r in left.collect())
    want = [(1, a), (2, other), (0, "x y z"), (7, ""), (7, ""), (8, ""), (3, "alone in here"), (9, "p q")]
    assert got == sorted((*w, "clash") for w in want)
    assert shingle_join.kept(df.limit(0)).collect() == []
