"""The ordinal model on made grades, and held-out accuracy on the given labels."""

from __future__ import annotations

import numpy as np
import pytest

from tomeweave.llm import toxicity
from tomeweave.llm.common import table

MEDIUM = "/root/testdata/sf0.01"


def test_gradient_descends_to_ordered_thresholds():
    rng = np.random.default_rng(0)
    held = rng.random((600, 12)) < 0.3
    true = np.array([3, 2, 2, 1, 0, 0, 0, -1, 0, 0, 0, 0.0])
    grade = np.digitize(held @ true + rng.logistic(size=600) * 0.5, [1.5, 3.5, 5.5])
    row, index = np.nonzero(held)
    w, cuts = toxicity.fit_ordinal(index, row, grade, 12)
    assert (np.diff(cuts) > 0).all() and np.corrcoef(w, true)[0, 1] > 0.97
    above = toxicity.Ordinal({}, tuple(cuts)).above(held @ w)
    assert (np.diff(above, axis=1) <= 0).all()
    assert np.corrcoef(above.sum(axis=1), grade)[0, 1] > 0.85


def test_held_out_accuracy(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    known, held_out = (labels.where(f"pmod(xxhash64(doc_id, 7L), 2) = {i}") for i in (0, 1))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.learned(docs, known))
    rows = scored.select("doc_id", "p_toxic", "severity", "grade", scored["toxic"].alias("said")).join(held_out.select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = ([r for r in rows if r["toxic"] == i] for i in (1, 0))
    assert sum(r["said"] for r in clean) <= 0.02 * len(clean)
    assert sum(r["said"] for r in toxic) >= 0.6 * len(toxic)
    assert np.mean([r["severity"] for r in toxic]) > 10 * np.mean([r["severity"] for r in clean])
    assert all(r["said"] == (r["grade"] > 0) == (r["p_toxic"] >= 0.5) for r in rows)
    assert all(0 <= r["p_toxic"] <= r["severity"] <= 2 for r in rows)


def test_stage_keeps_columns_and_clean_documents(spark, small):
    docs = table(spark, small, "documents")
    kept = toxicity.kept(spark, docs, small)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    toxic = {r["doc_id"] for r in toxicity.query(spark, small).collect() if r["toxic"]}
    assert left == {r["doc_id"] for r in docs.collect()} - toxic


def test_odd_rows(spark):
    rows = [(i, ("trash talk " if i % 3 == 0 else "fine words ") + f"w{i}", "a", 9) for i in range(60)]
    rows += [(100, None, "a", 9), (101, "", "a", 9), (None, "trash", "a", 9), (102, "trash " * 50_000, "a", 9), (103, "trash", "a", 9), (103, "trash", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, severity STRING, grade INT")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(5, 0), (None, 1), (101, None)], "doc_id LONG, toxic INT")
    model = toxicity.learned(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["toxic"] == (i % 3 == 0) for i in range(60))
    assert by[102]["toxic"] and by[103]["toxic"] and by[None]["toxic"] and not by[100]["toxic"] and by[100]["severity"] == by[101]["severity"]
    assert toxicity.score(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("toxic", [0, 1, None])
def test_one_grade_only(spark, toxic):
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(5)], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(i, toxic) for i in range(5)], "doc_id LONG, toxic INT")
    out = toxicity.score(docs, toxicity.learned(docs, labels)).collect()
    assert {r["toxic"] for r in out} == {bool(toxic)} and {r["severity"] for r in out} == {float(toxic or 0)}
