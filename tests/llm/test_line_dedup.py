"""Line dedup against plain edit distances and a plain walk over the lines."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tomeweave.llm import line_dedup
from tomeweave.llm.common import table

SCHEMA = "doc_id LONG, text STRING, source STRING, h LONG, dropped INT"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def one_apart(a, b):
    """At most one edit, by walking to the first difference."""
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def edited(rng, text, times):
    s = list(text)
    for _ in range(times):
        i, what = rng.randrange(len(s) + 1), rng.random()
        if what < 0.4 and i < len(s):
            s[i] = rng.choice("abé😀")
        elif what < 0.7:
            s.insert(i, rng.choice("abé😀"))
        elif i < len(s):
            del s[i]
    return "".join(s)


def brute(docs, least):
    """Texts without repeats, by place in ``docs``."""
    order = sorted((k for k, d in enumerate(docs) if d[1] is not None), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0))
    lines = sorted({x for k in order for x in docs[k][1].split("\n") if len(x) >= least})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= 1 and one_apart(a, b):
                root[find(a)] = find(b)
    seen, out = set(), [None] * len(docs)
    for k in order:
        kept = []
        for x in docs[k][1].split("\n"):
            if len(x) < least or find(x) not in seen:
                kept.append(x)
            if len(x) >= least:
                seen.add(find(x))
        out[k] = "\n".join(kept)
    return out


def test_one_apart():
    rng = random.Random(0)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(6)))
        b = edited(rng, a, rng.randrange(3))
        assert abs(len(a) - len(b)) > 1 or one_apart(a, b) == (distance(a, b) <= 1)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randrange(1, 14)))
        pairs.append((a, edited(rng, a, rng.randrange(5)) or "a"))
    df = spark.createDataFrame(pairs, "x STRING, y STRING")
    out = df.select("x", "y", line_dedup.within(F.split("x", ""), F.split("y", ""), edits).alias("near")).collect()
    assert all(r["near"] == (distance(r["x"], r["y"]) <= edits) for r in out)


@pytest.mark.parametrize("many", [1000, 4])
def test_equals_brute_force(spark, many):
    """Few lines a signature may hold: crowded ones are halved down to one character."""
    rng = random.Random(5)
    lines = []
    for _ in range(6):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(8, 20)))
        lines += [base] * 3 + [edited(rng, base, rng.randrange(3)) for _ in range(50)]
    lines += ["".join(rng.choice("abcdefgh ") for _ in range(12)) for _ in range(40)]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[4 * i : 4 * i + 4]), "s", 1, 2) for i in range(len(lines) // 4)]
    docs += [(None, None, "x", 1, 2), (1000, "", "x", 1, 2), (1001, "\n\n", "x", 1, 2), (1002, "é" * 30_000 + "\nab", "x", 1, 2), (1003, "é" * 30_001, "x", 1, 2)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    out = line_dedup.dedup(df, least=8, many=many)
    assert out.columns == [*df.columns, "_dropped"]
    got = {(r["doc_id"], r["source"]): r["text"] for r in out.collect()}
    assert got == {(d[0], d[2]): t for d, t in zip(docs, brute(docs, 8))}


def test_rows_of_equal_id_and_text_keep_the_same_lines(spark):
    rows = [(1, "a line that is long enough", "s", 1, 2)] * 2 + [(2, "a line that is long enough", "s", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup(df).collect()) == [(1, rows[0][1]), (1, rows[0][1]), (2, "")]
    assert line_dedup.dedup(df.limit(0)).collect() == []


def test_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    import hashlib

    rows = {r["doc_id"]: r for r in line_dedup.query(spark, small).collect()}
    assert rows.keys() == {d for d, _ in docs}
    for (d, text), left in zip(docs, brute(docs, line_dedup.LEAST)):
        assert rows[d]["text_sha256"] == hashlib.sha256(left.encode()).hexdigest()
        assert rows[d]["n_lines"] == len(text.split("\n"))
        assert rows[d]["n_dropped"] == len(text.split("\n")) - (len(left.split("\n")) if left or rows[d]["n_dropped"] < rows[d]["n_lines"] else 0)
