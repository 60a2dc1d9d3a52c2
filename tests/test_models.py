"""Learned models: invariants, twins and round trips."""

from __future__ import annotations

import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tomeweave.operators import evaluate, linear, stages, tables, terms
from tomeweave.operators.stages import DocumentStats
from tomeweave.plans import jobs
from tomeweave.plans.registry import models
from tomeweave.sources import sinks

WORDS = {
    "de": "die katze auf der matte und hund",
    "en": "the cat sat on mat hat dog",
    "fr": "le chat est sur la natte chien",
}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        lang = ("en", "en", "fr", "de")[i % 4]
        pool = WORDS[lang].split() + ["common", "zz"]
        rows.append((i, lang, " ".join(rng.choices(pool, k=rng.randint(4, 14))) + "."))
    return spark.createDataFrame(rows, "doc_id bigint, label string, text string").coalesce(2).cache()


@pytest.fixture(scope="module")
def evaluation(docs):
    return jobs.train_and_evaluate(docs, "doc_id", n_features=3, max_iter=40)


def test_probabilities_agree_with_predictions(evaluation):
    best = evaluate.argmax_label(evaluation.probabilities, "doc_id", score="probability")
    pairs = best.withColumnRenamed("prediction", "best").join(evaluation.predictions, "doc_id")
    assert pairs.filter("best <> prediction").count() == 0 and pairs.count() > 10
    sums = evaluation.probabilities.groupBy("doc_id").agg(F.sum("probability").alias("s"), F.count("*").alias("n"))
    assert sums.filter("abs(s - 1) > 1e-9 or n <> 3").count() == 0


def test_accuracy_beats_the_majority_class(evaluation):
    accuracy = evaluation.accuracy.first()[0]
    majority = evaluation.predictions.agg(F.avg((F.col("label") == "en").cast("double"))).first()[0]
    assert accuracy > majority
    n = evaluation.predictions.count()
    assert evaluation.matrix.agg(F.sum("n")).first()[0] == n
    total = evaluation.report.filter("label = 'avg / total'").first()
    assert total["support"] == n and total["recall"] == pytest.approx(accuracy)


def test_top_features_speak_the_language(evaluation):
    got = {(r["label"], r["term"]) for r in evaluation.top.collect()}
    assert len(got) == 9 and all(term in WORDS[label].split() for label, term in got)
    bottom = {(r["label"], r["term"]) for r in evaluation.bottom.collect()}
    assert not got & bottom


def test_mllib_tfidf_equals_the_relational_twin(docs):
    counts = terms.term_counts(docs, ["doc_id"])
    twin = terms.tfidf(counts, terms.inverse_document_frequency(counts, docs), "doc_id")
    want = {(r["doc_id"], r["term"]): r["tfidf"] for r in twin.collect()}
    model = Pipeline(stages=linear.tfidf_stages()).fit(docs)
    names = next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))
    rows = model.transform(docs).select("doc_id", vector_to_array("features").alias("v")).collect()
    got = {(r["doc_id"], names[i]): x for r in rows for i, x in enumerate(r["v"]) if x}
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("strategy", ["ovr", "multinomial"])
def test_classifier_round_trip(docs, tmp_path, strategy):
    model = linear.train(docs, strategy=strategy, max_iter=10)
    sinks.save_classifier(model, str(tmp_path / "m"))
    loaded = sinks.load_classifier(str(tmp_path / "m"))
    a = model.score(docs).select("doc_id", "prediction", "proba").orderBy("doc_id").collect()
    assert a == loaded.score(docs).select("doc_id", "prediction", "proba").orderBy("doc_id").collect()
    assert model.labels == loaded.labels == ("de", "en", "fr")


def test_feature_union_and_its_round_trip(spark, docs, tmp_path):
    stages = linear.union_stages(stats_weight=0.5, tfidf_weight=2.0)
    model = linear.train(docs, stages=stages, max_iter=10)
    names = model.feature_names()
    assert names[:3] == ["stats:length", "stats:num_sentences", "stats:avg_sentence_length"]
    assert model.coefficients(spark).count() == 3 * len(names)
    model.features.write().overwrite().save(str(tmp_path / "f"))
    loaded = PipelineModel.load(str(tmp_path / "f"))
    assert isinstance(loaded.stages[0], DocumentStats)
    v = loaded.transform(docs).select(vector_to_array("features").alias("v")).first()["v"]
    assert sum(x * x for x in v[3:]) == pytest.approx(4.0)


def test_ngram_stages(docs):
    for stages, size in (
        (linear.tfidf_stages(ngram=3, stop_words=["the"], vocab_size=50), 3),
        (linear.tfidf_stages(ngram=4, vocab_size=50), 4),
    ):
        model = Pipeline(stages=stages).fit(docs)
        names = next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))
        assert len(names) <= 50 and all(len(n.split(" ")) == size for n in names)
    chars = Pipeline(stages=linear.tfidf_stages(ngram=2, analyzer="char")).fit(docs)
    names = next(s.vocabulary for s in chars.stages if hasattr(s, "vocabulary"))
    assert all(len(n) == 2 for n in names)


def test_grid_search_covers_every_combination(docs):
    best, results = linear.grid_search(
        docs, "doc_id", vocab_sizes=(5, 20), ngrams=(1, 2), costs=(0.1, 10.0), penalties=("l1", "l2"), folds=2, max_iter=5
    )
    assert results.count() == 16 and results.filter("accuracy between 0 and 1").count() == 16
    assert max(best.avgMetrics) == results.agg(F.max("accuracy")).first()[0]


def test_grid_search_over_block_weights(docs):
    _, results = linear.grid_search(
        docs, "doc_id", vocab_sizes=(20,), weights=((1.0, 0.75), None), costs=(1.0,), penalties=("l2",), folds=2, max_iter=3
    )
    got = {(r["tfidf_weight"], r["stats_weight"]) for r in results.collect()}
    assert got == {(1.0, 0.75), (None, None)}


def test_vocabulary_is_whole_and_does_not_depend_on_partitions(spark, monkeypatch):
    rows = [(i, f"tie{i % 40} tie{(i + 1) % 40} w{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    found = [
        next(s.vocabulary for s in Pipeline(stages=linear.tfidf_stages(vocab_size=size)).fit(df.repartition(n)).stages if hasattr(s, "vocabulary"))
        for size, n in ((25, 1), (25, 7), (None, 3))
    ]
    assert found[0] == found[1] == sorted(f"tie{i}" for i in range(40))[:25]
    assert len(found[2]) == 240
    monkeypatch.setattr(stages, "MOST_TERMS", 10)
    with pytest.raises(ValueError, match="240 terms"):
        Pipeline(stages=linear.tfidf_stages()).fit(df)


@pytest.mark.parametrize("options", [{"analyzer": "char", "ngram": 3}, {"ngram": 2, "stop_words": ("the", "le")}, {}])
def test_tokens_are_made_once_for_a_vocabulary(docs, monkeypatch, options):
    """No filter derived from the exploded array makes them again, and no term is sent to the JVM by itself."""
    plans = []

    def store(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialise(df, name)

    materialise = stages.materialise
    monkeypatch.setattr(stages, "materialise", store)
    monkeypatch.setattr(stages.CountVectorizerModel, "from_vocabulary", None)
    texts = docs.select("doc_id", F.concat("text", F.lit(" end")).alias("text"))
    before = linear.tfidf_stages(vocab_size=30, **options)
    at = next(i for i, s in enumerate(before) if isinstance(s, stages.TermVocabulary))
    ready = PipelineModel(before[:at]).transform(texts)
    counter = before[at].fit(ready)
    made = max(plans[0].count("regexp_extract_all("), plans[0].count("UDF("))
    assert made == sum(not isinstance(s, stages.TermVocabulary) for s in before[:at])
    found = ready.select(F.explode(before[at].getInputCol()).alias("t")).groupBy("t").count().collect()
    assert counter.vocabulary == [r["t"] for r in sorted(found, key=lambda r: (-r["count"], r["t"]))][:30]


def test_a_vocabulary_without_terms_is_a_blank(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "doc_id int, text string").fillna("")
    for size in (None, 5):
        fitted = Pipeline(stages=linear.tfidf_stages(vocab_size=size)).fit(df)
        assert next(s.vocabulary for s in fitted.stages if hasattr(s, "vocabulary")) == [" "]


def test_mllib_bayes_sums_in_no_more_tasks_than_cores(spark, small, monkeypatch):
    """Each holds a row as long as the vocabulary for each label."""
    seen = []

    class Seen:
        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return bayes().fit(df)

    bayes = linear.naive_bayes
    monkeypatch.setattr(linear, "naive_bayes", Seen)
    monkeypatch.setattr("tomeweave.plans.registry.tables.spread", lambda df, *keys: df.repartition(23))
    assert models.nb_mllib(spark, small).count() > 0
    assert seen == [spark.sparkContext.defaultParallelism]


def test_split_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    train, test = terms.split_by_hash(df, "k")
    assert train.count() + test.count() == 3 and train.filter("k is null").count() == 1


def test_predictions_fill_the_catalog(spark, docs):
    scored = linear.train(docs, max_iter=10).score(docs)
    predictions = scored.select(F.col("doc_id").cast("string").alias("isbn"), "prediction")
    catalog = spark.createDataFrame([("0", None), ("999", "old"), ("998", None)], "isbn string, genres_predicted string")
    got = {r["isbn"]: r["genres_predicted"] for r in linear.predict_into_catalog(predictions, catalog).collect()}
    assert got["999"] == "old" and got["998"] is None and got["0"] in WORDS


def test_mllib_bayes_agrees_with_the_relational_one(spark, small):
    from tomeweave.plans.registry import models

    a = models.nb_mllib(spark, small).withColumnRenamed("prediction", "mllib")
    both = a.join(models.nb_predict(spark, small), ["doc_id", "label"])
    assert both.count() > 0
    # The smoothed prior may tip a close call.
    assert both.filter("mllib <> prediction").count() <= 0.05 * both.count()


def test_ngram_and_union_classifiers_are_fitted_and_scored(spark, small, monkeypatch):
    """With the reference's cap, and on the features that their names promise."""
    fitted = []

    def train(rows, **options):
        fitted.append(linear_train(rows, **options))
        return fitted[-1]

    linear_train = linear.train
    monkeypatch.setattr(linear, "train", train)
    sizes = {}
    for name in ("lr_ngram_predict", "lr_char_ngram_predict", "lr_stats_union_predict"):
        assert models.QUERIES[name](spark, small).count() > 20
        names = fitted[-1].feature_names()
        sizes[name] = len(names)
        assert 2000 < len(names) <= 50000 + 3
    assert sizes["lr_ngram_predict"] > 5000
    assert len(fitted) == 3


@pytest.mark.parametrize("strategy", ["ovr", "multinomial"])
def test_many_terms_are_fitted_in_tables(spark, docs, monkeypatch, tmp_path, strategy):
    """Beyond DRIVER_TERMS no vocabulary is collected; weights, scores and the saved model stay the same."""
    twice = docs.unionByName(docs.where("doc_id % 2 = 0")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("int")))
    stages_of = lambda: linear.union_stages(stats_weight=0.5, tfidf_weight=2.0)
    vectors = linear.train(twice, stages=stages_of(), strategy=strategy, max_iter=1000)
    monkeypatch.setattr(tables, "DRIVER_TERMS", 5)
    monkeypatch.setattr(tables, "TOLERANCE", 1e-6)
    monkeypatch.setattr(stages, "MOST_TERMS", 0)
    model = linear.train(twice, stages=stages_of(), strategy=strategy, max_iter=1000)
    assert isinstance(model, tables.TableTextClassifier) and model.labels == ("de", "en", "fr")
    want = {(r["label"], r["term"]): r["weight"] for r in vectors.coefficients(spark).collect()}
    got = {(r["label"], r["term"]): r["weight"] for r in model.coefficients(spark).collect()}
    assert {k: v for k, v in got.items() if abs(v) > 1e-9} == pytest.approx({k: v for k, v in want.items() if abs(want[k]) > 1e-9 and k in got}, abs=0.02)
    rows = lambda m: m.score(twice).select("doc_id", "text", "prediction", "proba").orderBy("doc_id", "text").collect()
    a, b = rows(vectors), rows(model)
    assert [r["prediction"] for r in a] == [r["prediction"] for r in b]
    for x, y in zip(a, b, strict=True):
        assert [p["probability"] for p in x["proba"]] == pytest.approx([p["probability"] for p in y["proba"]], abs=0.01)
    sinks.save_classifier(model, str(tmp_path / "m"))
    assert rows(sinks.load_classifier(str(tmp_path / "m"))) == b


@pytest.mark.parametrize("name", ["lr_tfidf", "lr_stats_union"])
def test_feature_queries_in_tables_equal_those_in_vectors(spark, small, monkeypatch, name):
    key = lambda r: tuple(str(x) for x in r[:2])
    want = sorted(models.QUERIES[name](spark, small).collect(), key=key)
    monkeypatch.setattr(tables, "DRIVER_TERMS", 5)
    monkeypatch.setattr(stages, "MOST_TERMS", 0)
    got = sorted(models.QUERIES[name](spark, small).collect(), key=key)
    assert len(got) == len(want) > 20
    for a, b in zip(got, want, strict=True):
        assert a.asDict() == pytest.approx(b.asDict(), abs=2e-6)


def test_grid_search_makes_a_vocabulary_once_and_agrees_with_mllib(docs, monkeypatch):
    """A vocabulary for each fold and one for the best model, not one for each combination."""
    made, fit = [], stages.TermVocabulary._fit

    def counted(self, dataset):
        made.append(self.getOrDefault(self.vocabSize))
        return fit(self, dataset)

    monkeypatch.setattr(stages.TermVocabulary, "_fit", counted)
    best, results = linear.grid_search(
        docs, "doc_id", vocab_sizes=(4, 20), costs=(1.0,), penalties=("l1", "l2"), weights=((1.0, 0.5),), folds=2
    )
    assert len(made) == 3 and made[:2] == [20, 20]
    assert best.avgMetrics == [r["accuracy"] for r in results.collect()]
    monkeypatch.setattr(stages.TermVocabulary, "_fit", fit)
    folded = docs.withColumn("label_index", F.expr("CAST(array_position(array('de', 'en', 'fr'), label) - 1 AS DOUBLE)"))
    folded = folded.withColumn("_fold", linear.hash_bucket(F.col("doc_id"), 2).cast("int"))
    for r in results.collect():
        hits = []
        for fold in range(2):
            lr = linear.classifier(docs.count() // 2, "multinomial", 1.0, r["penalty"])
            steps = [*linear.union_stages(tfidf_weight=1.0, stats_weight=0.5, vocab_size=r["vocab_size"]), lr]
            model = Pipeline(stages=steps).fit(folded.where(F.col("_fold") != fold))
            scored = model.transform(folded.where(F.col("_fold") == fold))
            hits.append(scored.agg(F.avg((F.col("prediction") == F.col("label_index")).cast("double"))).first()[0])
        assert r["accuracy"] == pytest.approx(sum(hits) / 2, abs=0.04)
