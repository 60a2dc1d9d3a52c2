"""The linear model that lives in a table: its optimum, its plans and its proof."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeweave.operators import blocks, evaluate, linear, logistic
from tomeweave.operators.terms import inverse_document_frequency, term_counts, tfidf
from tomeweave.plans.registry import models
from tomeweave.sources.workspace import discard, materialise


@pytest.fixture(scope="module")
def data(spark):
    """Sparse documents of three classes; one has no features, one an unknown mark."""
    rng = np.random.default_rng(1)
    rows, docs = [], []
    for i in range(90):
        k = i % 3
        docs.append((i, "abc"[k]))
        for t in rng.choice(30, rng.integers(1, 9), replace=False):
            rows.append((i, f"t{t}", float(abs(rng.normal()) + (t % 3 == k))))
    docs.append((90, "a"))
    features = spark.createDataFrame(rows, "doc_id LONG, term STRING, tfidf DOUBLE")
    return features, spark.createDataFrame(docs, "doc_id LONG, label STRING")


def dense(data):
    features, docs = data
    terms = sorted({r["term"] for r in features.collect()})
    at = {r["doc_id"]: i for i, r in enumerate(docs.collect())}
    x = np.zeros((len(at), len(terms)))
    for r in features.collect():
        x[at[r["doc_id"]], terms.index(r["term"])] = r["tfidf"]
    return x, np.array([r["label"] for r in docs.collect()]), terms


def newton(x, y, penalty):
    """The optimum by whole Newton steps, intercept last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) / len(x) + ridge @ w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge, g)
    return w, g


@pytest.mark.parametrize("few, c", [(500_000, 10.0), (0, 1.0)])
def test_the_optimum_is_reached(spark, data, c, few, monkeypatch):
    """Also where no side is broadcast."""
    monkeypatch.setattr(logistic, "FEW", few)
    model = logistic.fit(*data, "doc_id", c=c, tol=1e-6)
    x, labels, terms = dense(data)
    weights = {(r["label"], r["term"]): r["weight"] for r in model.coefficients().collect()}
    assert model.labels == ("a", "b", "c") and len(weights) == 3 * len(terms) and model.steps < 60
    for k, label in enumerate(model.labels):
        want, _ = newton(x, (labels == label).astype(float), 1 / (c * len(x)))
        got = [weights[label, t] for t in terms] + [model.intercepts[k]]
        assert np.abs(np.array(got) - want).max() < 1e-4


def test_mllib_has_the_same_optimum(spark, data):
    """Same penalty, same classes against the rest."""
    x, labels, terms = dense(data)
    rows = spark.createDataFrame([(str(y), " ".join(f"{t} " * int(round(v)) for t, v in zip(terms, r) if v)) for r, y in zip(x, labels)], "label STRING, text STRING")
    rows = materialise(rows.withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    table = logistic.train(rows, "doc_id", tol=1e-6)
    mllib = linear.train(rows, max_iter=1000)
    pairs = table.model.coefficients().join(
        mllib.coefficients(spark).withColumnRenamed("weight", "other"), ["label", "term"], "full"
    )
    assert pairs.where("weight IS NULL OR other IS NULL").count() == 0
    assert pairs.agg(F.max(F.abs(F.col("weight") - F.col("other")))).first()[0] < 0.02  # MLlib's tolerance
    counts = term_counts(rows, ["doc_id"])
    features = materialise(tfidf(counts, inverse_document_frequency(counts, rows), "doc_id"), "features")
    left = logistic.optimality(table.model.coefficients(), table.model.intercept_rows(), features, rows, "doc_id")
    assert left.where("gradient > 1e-6 * at_zero * 1.01").count() == 0
    theirs = logistic.optimality(mllib.coefficients(spark), linear.intercept_rows(mllib, spark), features, rows, "doc_id")
    assert theirs.where("gradient > 0.01 * at_zero").count() == 0


@pytest.mark.parametrize("strategy", ["ovr", "multinomial"])
def test_optimality_is_the_gradient(spark, data, strategy):
    features, docs = data
    x, labels, terms = dense(data)
    rng = np.random.default_rng(2)
    w, b = rng.normal(size=(3, len(terms))), rng.normal(size=3)
    weights = spark.createDataFrame([("abc"[k], t, float(w[k, i])) for k in range(3) for i, t in enumerate(terms)], "label STRING, term STRING, weight DOUBLE")
    intercepts = spark.createDataFrame([("abc"[k], float(b[k])) for k in range(3)], "label STRING, intercept DOUBLE")
    got = {r["label"]: r for r in logistic.optimality(weights, intercepts, features, docs, "doc_id", c=2.0, strategy=strategy).collect()}
    for zero in (False, True):
        m = 0 * (x @ w.T) if zero else x @ w.T + b
        p = 1 / (1 + np.exp(-m)) if strategy == "ovr" else np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
        for k in range(3):
            r = (p[:, k] - (labels == "abc"[k])) / len(x)
            g = np.append(x.T @ r + (0 if zero else w[k] / (2 * len(x))), r.sum())
            assert got["abc"[k]]["at_zero" if zero else "gradient"] == pytest.approx(np.linalg.norm(g))


def test_scores_and_round_trip(spark, data, tmp_path):
    features, docs = data
    model = logistic.fit(features, docs, "doc_id", tol=1e-2)
    logistic.save_model(model, str(tmp_path / "m"))
    loaded = logistic.load_model(spark, str(tmp_path / "m"))
    assert (loaded.labels, loaded.intercepts, loaded.steps, loaded.gradient) == (model.labels, model.intercepts, model.steps, model.gradient)
    known = features.unionByName(spark.createDataFrame([(1, "unseen", 9.0)], features.schema))
    a, b = (logistic.score(m, known, docs, "doc_id").orderBy("doc_id").collect() for m in (model, loaded))
    assert a == b and len(a) == 91
    x, labels, terms = dense(data)
    weights = {(r["label"], r["term"]): r["weight"] for r in model.coefficients().collect()}
    for r, row in zip(a, x):
        m = [sum(v * weights[c, t] for v, t in zip(row, terms)) + model.intercepts[k] for k, c in enumerate("abc")]
        p = [1 / (1 + math.exp(-z)) for z in m]
        assert [q["probability"] for q in r["proba"]] == pytest.approx([z / sum(p) for z in p])
        assert r["prediction"] == "abc"[p.index(max(p))]
    assert sum(r["prediction"] == r["label"] for r in a) > 60


def test_no_documents_and_one_class(spark, data):
    features, docs = data
    none = logistic.fit(features.limit(0), docs.limit(0), "doc_id")
    assert none.labels == () and none.coefficients().collect() == [] and none.steps == 0
    one = logistic.fit(features, docs.withColumn("label", F.lit("x")), "doc_id", max_steps=2)
    scored = logistic.score(one, features, docs, "doc_id").collect()
    assert {r["prediction"] for r in scored} == {"x"} and all(r["proba"][0]["probability"] == 1.0 for r in scored)


def test_tables_of_finished_steps_are_deleted(spark, data):
    written = []
    stored = logistic.materialise

    def noted(df, name):
        written.append(stored(df, name))
        return written[-1]

    logistic.materialise = noted
    try:
        model = logistic.fit(*data, "doc_id", max_steps=4)
    finally:
        logistic.materialise = stored
    folders = {f.rpartition("/")[0].removeprefix("file://").removeprefix("file:") for t in written for f in t.inputFiles()}
    left = {f for f in folders if os.path.isdir(f)}
    assert len(left) == 1 and "/model-" in left.pop() and len(written) > 10
    assert model.weights.count() == 30


def test_only_own_tables_are_deleted(spark, tmp_path):
    path = str(tmp_path / "kept")
    spark.range(3).write.parquet(path)
    discard(spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 3


def test_step_lengths():
    at = logistic.LENGTHS
    assert logistic._length([-1.0, *[a - 1.0 for a in at]]) == pytest.approx(1.0)
    assert logistic._length([-1.0, *[a - 0.1 for a in at]]) == pytest.approx(0.25 / 1.15)
    assert logistic._length([-1.0] * (1 + len(at))) == at[-1]
    assert logistic._length([0.0] * (1 + len(at))) in (0.0, *at)


def test_skill(spark):
    rows = [("a", "a", 0.9), ("a", "b", 0.4), ("b", "b", 0.2), ("a", "a", 0.8)]
    scored = spark.createDataFrame([(y, p, [("a", q), ("b", 1 - q)]) for y, p, q in rows], "label STRING, prediction STRING, proba ARRAY<STRUCT<label: STRING, probability: DOUBLE>>")
    got = evaluate.skill(scored).first()
    assert (got["accuracy"], got["majority"]) == (0.75, 0.75)
    assert got["log_loss"] == pytest.approx(-(math.log(0.9) + math.log(0.4) + math.log(0.8) + math.log(0.8)) / 4)
    assert got["base_loss"] == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))


@pytest.mark.parametrize("steps", [0, 1000])
def test_an_untrained_model_fails_the_oracle(spark, small, monkeypatch, steps):
    """The columns that SQL states as true tell a fitted model from an untrained and a constant one."""
    fit = logistic.fit
    short = {"max_steps": steps} if not steps else {}
    monkeypatch.setattr(logistic, "fit", lambda *a, **k: fit(*a, **{**k, **short}))
    row = models.lr_table_predict(spark, small).first()
    optimum = models.lr_table_optimum(spark, small).collect()
    assert row["informed"] == row["beats_majority"] == bool(steps)
    assert {r["at_optimum"] for r in optimum} == {bool(steps)}


def test_sparse_rows_read_both_kinds_of_vectors(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import StructType

    rows = [(1, Vectors.sparse(5, [1, 3], [2.0, 0.0])), (2, Vectors.dense([0.0, 4.0])), (3, Vectors.sparse(5, [], []))]
    df = spark.createDataFrame(rows, StructType().add("k", "integer").add("v", VectorUDT()))
    assert sorted(tuple(r) for r in linear.sparse_rows(df, ["k"], "v").collect()) == [(1, 1, 2.0), (2, 1, 4.0)]


def test_frequent_and_rare_terms_meet_in_one_optimum(spark, data, monkeypatch):
    """With ten of the thirty terms broadcast at most."""
    monkeypatch.setattr(logistic, "FEW", 40)
    numbers = [r["t"] % 2 for r in logistic._numbered(data[0]).collect()]
    assert len(numbers) == 30 and 0 < numbers.count(0) <= 10
    model = logistic.fit(*data, "doc_id", tol=1e-3)
    left = logistic.optimality(model.coefficients(), model.intercept_rows(), *data, "doc_id")
    assert left.where("gradient > 1.01e-3 * at_zero").count() == 0 and model.steps < 80
    assert {r["label"]: r["at_zero"] for r in left.collect()} == pytest.approx(dict(zip(model.labels, model.at_zero)))


def test_documents_are_never_broadcast(spark, data, monkeypatch):
    """Residuals are brought to the buckets of the features; the driver would have to collect them."""
    monkeypatch.setattr(logistic, "FEW", 8)  # some terms are rare
    plans = {}

    def recorded(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, name)

    monkeypatch.setattr(logistic, "materialise", recorded)
    model = logistic.fit(*data, "doc_id", tol=1e-6, max_steps=2)
    steps = plans["weights"][1:]
    assert model.steps == 2 and len(steps) == 3
    for text in steps:
        assert text.count("ShuffledHashJoin [row") == 2 and "BroadcastHashJoin" not in text
        assert text.count("Bucketed: true") == 2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tomeweave_")]


@pytest.fixture
def in_blocks(monkeypatch):
    """Small blocks for small tables."""
    monkeypatch.setattr(blocks, "LEAST", 0)
    monkeypatch.setattr(blocks, "BLOCK", 100)
    monkeypatch.setattr(blocks, "RANGE", 7)
    monkeypatch.setattr(logistic, "_Fit", None)


@pytest.mark.parametrize("strategy", ["ovr", "multinomial"])
def test_blocks_reach_the_optimum(spark, data, in_blocks, strategy):
    """Also of terms that one document holds."""
    features, docs = data
    alone = spark.createDataFrame([(i, f"own{i}-{j}", 0.5 + j) for i in range(0, 90, 4) for j in range(2)], features.schema)
    features = features.unionByName(alone)
    model = logistic.fit(features, docs, "doc_id", tol=1e-6, strategy=strategy)
    left = logistic.optimality(model.coefficients(), model.intercept_rows(), features, docs, "doc_id", strategy=strategy)
    assert left.where("gradient > 1.01e-6 * at_zero").count() == 0 and model.steps < 30
    assert model.weights.count() == model.weights.select("term").distinct().count() == 30 + 46
    assert {r["label"]: r["gradient"] for r in left.collect()} == pytest.approx(dict(zip(model.labels, model.gradient)), rel=1e-3)
    assert {r["label"]: r["at_zero"] for r in left.collect()} == pytest.approx(dict(zip(model.labels, model.at_zero)))


def test_blocks_are_as_large_as_asked_and_go_with_the_fit(spark, data, in_blocks, monkeypatch):
    written, counts = [], []

    def noted(df, name):
        written.append(materialise(df, name))
        if name == "blocks":
            counts.append(written[-1].count())
        return written[-1]

    monkeypatch.setattr(blocks, "materialise", noted)
    model = logistic.fit(*data, "doc_id", max_steps=2)
    assert model.steps == 2 and model.weights.count() == 30 and counts[0] > 1
    folders = {f.rpartition("/")[0].removeprefix("file://").removeprefix("file:") for t in written for f in t.inputFiles()}
    left = {f for f in folders if os.path.isdir(f)}
    assert len(left) == 1 and "/model-" in left.pop()


def test_blocks_leave_other_fits_to_tables(spark, data, monkeypatch):
    features, docs = data
    monkeypatch.setattr(blocks, "LEAST", 0)
    assert blocks.suits(features, docs, "doc_id", "label").count() == 30
    twice, null = docs.unionByName(docs.limit(1)), docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert blocks.suits(features, twice, "doc_id", "label") is None and blocks.suits(features, null, "doc_id", "label") is None
    monkeypatch.setattr(blocks, "NUMBERS", 3 * (30 + 91))
    assert blocks.suits(features, docs, "doc_id", "label") is None
    monkeypatch.setattr(blocks, "NUMBERS", 10**6)
    monkeypatch.setattr(blocks, "LEAST", features.count() + 1)
    assert blocks.suits(features, docs, "doc_id", "label") is None
