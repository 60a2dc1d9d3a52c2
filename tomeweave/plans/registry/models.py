"""Naive Bayes, logistic regression and evaluation queries."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizerModel, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeweave.functions.text import WORD
from tomeweave.operators import bayes, evaluate, linear, logistic, tables
from tomeweave.operators.groups import bottom_features, top_features
from tomeweave.operators.stages import STATS_COLUMNS, TermVocabulary
from tomeweave.operators.terms import inverse_document_frequency, split_by_hash, term_counts, tfidf
from tomeweave.plans import jobs
from tomeweave.plans.registry.tables import documents, sql_list, table
from tomeweave.plans.registry.terms import BUCKET_SQL, STOP_WORDS, TERM_COUNTS_SQL
from tomeweave.sources import sinks
from tomeweave.sources.workspace import broadcast_if_few, fresh_path, materialise


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, d, "lang", "text").withColumnRenamed("lang", "label")
    return split_by_hash(docs, "doc_id")


def _bayes(spark: SparkSession, d: str) -> tuple[bayes.BayesModel, DataFrame]:
    train, test = _parts(spark, d)
    model = bayes.fit(term_counts(train, ["label"]), train)
    return model, bayes.score(model, term_counts(test, ["doc_id"]), test, "doc_id", ["label"])


def nb_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = bayes.score_rows(_bayes(spark, d)[1], ["doc_id"])
    return rows.withColumn("score", F.round("score", 4))


def nb_predict(spark: SparkSession, d: str) -> DataFrame:
    return bayes.predict(_bayes(spark, d)[1], ["doc_id", "label"])


def nb_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The same prediction from score rows."""
    rows = bayes.score_rows(_bayes(spark, d)[1], ["doc_id"])
    return evaluate.argmax_label(rows, "doc_id")


def nb_proba(spark: SparkSession, d: str) -> DataFrame:
    rows = bayes.score_rows(bayes.probabilities(_bayes(spark, d)[1], "doc_id"), ["doc_id"], "proba")
    return rows.withColumn("probability", F.round("probability", 4))


def nb_tfidf_scores(spark: SparkSession, d: str) -> DataFrame:
    """Naive Bayes over tf-idf weights instead of counts, both fitted on the training texts."""
    train, test = _parts(spark, d)
    counts = term_counts(train, ["doc_id", "label"])
    idf = inverse_document_frequency(counts, train)
    model = bayes.fit(tfidf(counts, idf, "doc_id"), train, weight="tfidf")
    known = tfidf(term_counts(test, ["doc_id"]), idf, "doc_id")
    rows = bayes.score_rows(bayes.score(model, known, test, "doc_id", weight="tfidf"), ["doc_id"])
    return rows.withColumn("score", F.round("score", 4))


def write_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """The probability rows as JSON files, read back."""
    path = fresh_path(spark, "probabilities")
    rows = nb_proba(spark, d)
    sinks.write_probabilities(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


# The reference's cap of an n-gram vocabulary.
MOST_FEATURES = 50000


# What holds of any classifier that has learned and SQL can state without fitting one: every document
# is scored once, the probabilities are a distribution over the labels, the prediction is its mode,
# and over all held-out documents they say more than the labels' shares do, which no constant or
# untrained model does.
def _sound(scored: DataFrame) -> DataFrame:
    # Stored, so that no expression below scores the texts once more.
    scored = materialise(scored.select("doc_id", "label", "prediction", "proba"), "scored")
    values = F.transform("proba", lambda p: p["probability"])
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    best = F.array_max(values)
    said = F.filter("proba", lambda p: p["label"] == F.col("prediction"))
    found = evaluate.skill(scored).first()
    return scored.select(
        "doc_id",
        "label",
        F.size("proba").cast("bigint").alias("n_labels"),
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (F.array_min(values) >= 0).alias("non_negative"),
        (F.get(said, F.lit(0))["probability"] == best).alias("is_mode"),
        F.lit(found["log_loss"] < found["base_loss"]).alias("informed"),
        F.lit(found["accuracy"] > found["majority"]).alias("beats_majority"),
    )


def lr_saved(spark: SparkSession, d: str) -> DataFrame:
    """A model saved and loaded scores as the one that was fitted."""
    train, test = _parts(spark, d)
    path = fresh_path(spark, "classifier")
    fitted = linear.train(train)
    sinks.save_classifier(fitted, path)
    before = fitted.score(test).select("doc_id", "label", "prediction", "proba")
    after = sinks.load_classifier(path).score(test).select("doc_id", F.col("prediction").alias("p"), F.col("proba").alias("q"))
    same = (F.col("p") == F.col("prediction")) & (F.col("q") == F.col("proba"))
    return before.join(after, "doc_id").select("doc_id", "label", same.alias("same"))


def nb_top_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d, top_features)


def nb_bottom_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d, bottom_features)


def _features(spark: SparkSession, d: str, pick) -> DataFrame:
    train, _ = _parts(spark, d)
    model = bayes.fit(term_counts(train, ["label"]), train)
    # Rounded before ranking, so that equal weights rank by term on every engine.
    weights = bayes.feature_weights(model).withColumn("weight", F.round("weight", 6))
    return pick(weights, "label", "term", "weight", 25)


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion_matrix(nb_predict(spark, d))


def confusion_matrix_normalised(spark: SparkSession, d: str) -> DataFrame:
    matrix = evaluate.normalise_rows(confusion_matrix(spark, d))
    return matrix.withColumn("share", F.round("share", 6))


def confusion_matrix_wide(spark: SparkSession, d: str) -> DataFrame:
    labels = evaluate.label_list(table(spark, d, "documents"), "lang")
    return evaluate.pivot_matrix(confusion_matrix(spark, d), labels)


def classification_report(spark: SparkSession, d: str) -> DataFrame:
    report = evaluate.classification_report(nb_predict(spark, d))
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy(nb_predict(spark, d))


def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.distinct_labels(table(spark, d, "documents"), "lang")


def nb_mllib(spark: SparkSession, d: str) -> DataFrame:
    """MLlib's naive Bayes over the same split."""
    train, test = _parts(spark, d)
    stages = [
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=WORD, gaps=False),
        TermVocabulary(inputCol="tokens", outputCol="counts"),
        StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc"),
    ]
    features = Pipeline(stages=stages).fit(train)
    # An attribute for every term would stand in the schema of each file.
    counts = features.transform(train).select(F.col("counts").alias("counts", metadata={}), "label_index")
    # A task of the fit sums a row as long as the vocabulary for each label: no more tasks than cores.
    counts = materialise(counts, "counts").coalesce(spark.sparkContext.defaultParallelism)
    model = linear.naive_bayes().fit(counts)
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=features.stages[2].labels)
    return names.transform(model.transform(features.transform(test))).select(
        "doc_id", "label", F.col("predicted").alias("prediction")
    )


def _lr(spark: SparkSession, d: str, **options) -> tuple[linear.TextClassifier, DataFrame]:
    train, test = _parts(spark, d)
    model = linear.train(train, **options)
    return model, model.score(test)


def lr_predict(spark: SparkSession, d: str) -> DataFrame:
    return _sound(_lr(spark, d)[1])


def lr_proba(spark: SparkSession, d: str) -> DataFrame:
    scored = materialise(_lr(spark, d)[1].select("doc_id", F.col("label").alias("truth"), "proba"), "scored")
    rows = linear.probability_rows(scored.drop("truth"), "doc_id")
    # Of the documents of each true label, the mean probability of that label is the greatest.
    means = linear.probability_rows(scored, "truth").groupBy("truth", "label").agg(F.avg("probability").alias("p"))
    best = means.groupBy(F.col("truth").alias("label")).agg((F.max_by("label", "p") == F.col("truth")).alias("favoured"))
    return rows.join(F.broadcast(best), "label", "left").select(
        "doc_id", "label", F.col("probability").between(0, 1).alias("is_probability"), F.coalesce("favoured", F.lit(False)).alias("favoured")
    )


def lr_multinomial(spark: SparkSession, d: str) -> DataFrame:
    return _sound(_lr(spark, d, strategy="multinomial")[1])


def _ranked_weights(spark: SparkSession, d: str, pick, sign: int) -> DataFrame:
    """25 ranks per label, in order of weight, of terms that the training texts hold."""
    train, _ = _parts(spark, d)
    found = pick(linear.train(train).coefficients(spark), "label", "term", "weight", 25)
    known = term_counts(train, []).select("term").distinct().withColumn("known", F.lit(True))
    before = F.lag("weight").over(Window.partitionBy("label").orderBy("rank"))
    ordered = F.coalesce(sign * F.col("weight") <= sign * before, F.lit(True))
    return found.join(known, "term", "left").select(
        "label", "rank", ordered.alias("ordered"), F.coalesce("known", F.lit(False)).alias("known"),
        (sign * F.col("weight") > 0).alias("signed"),
    )


def lr_top_features(spark: SparkSession, d: str) -> DataFrame:
    return _ranked_weights(spark, d, top_features, 1)


def lr_bottom_features(spark: SparkSession, d: str) -> DataFrame:
    return _ranked_weights(spark, d, bottom_features, -1)


def _table_fit(spark: SparkSession, d: str) -> tuple[logistic.TableClassifier, DataFrame, DataFrame]:
    train, test = _parts(spark, d)
    return logistic.train(train, "doc_id"), train, test


def lr_table_predict(spark: SparkSession, d: str) -> DataFrame:
    """The model whose coefficients are a table, on the held-out texts."""
    model, _, test = _table_fit(spark, d)
    return _sound(model.score(test, "doc_id"))


def lr_table_optimum(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each class's gradient, by an aggregate over the features that trusts no solver;
    and every term of the training texts with a weight per class, as ``n_terms``."""
    model, train, _ = _table_fit(spark, d)
    weights = materialise(model.model.coefficients(), "coefficients")
    left = logistic.optimality(weights, model.model.intercept_rows(), model.features(train, "doc_id"), train, "doc_id")
    terms = weights.groupBy("label").agg(F.count("*").alias("n_terms"))
    return left.join(terms, "label").select(
        "label", F.round("at_zero", 6).alias("at_zero"), (F.col("gradient") < 2e-4 * F.col("at_zero")).alias("at_optimum"), "n_terms"
    )


def lr_optimum(spark: SparkSession, d: str) -> DataFrame:
    """The same of ``linear``'s models of both strategies; MLlib's stop at 100 steps, before the optimum."""
    train, _ = _parts(spark, d)
    counts = term_counts(train, ["doc_id"])
    features = materialise(tfidf(counts, inverse_document_frequency(counts, train), "doc_id"), "features")
    out = None
    for strategy in ("ovr", "multinomial"):
        model = linear.train(train, strategy=strategy)
        weights = materialise(model.coefficients(spark), "coefficients")
        left = logistic.optimality(weights, linear.intercept_rows(model, spark), features, train, "doc_id", strategy=strategy)
        rows = left.select(
            F.lit(strategy).alias("strategy"), "label", F.round("at_zero", 6).alias("at_zero"),
            (F.col("gradient") < 0.3 * F.col("at_zero")).alias("is_trained"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def lr_table_top_features(spark: SparkSession, d: str) -> DataFrame:
    """25 terms per label by falling weight, with the one of the same rank by rising weight."""
    weights = materialise(_table_fit(spark, d)[0].model.coefficients(), "coefficients")
    top = top_features(weights, "label", "term", "weight", 25).withColumnsRenamed({"term": "top", "weight": "high"})
    bottom = bottom_features(weights, "label", "term", "weight", 25).withColumnsRenamed({"term": "bottom", "weight": "low"})
    before = Window.partitionBy("label").orderBy("rank")
    falls = F.coalesce(F.col("high") <= F.lag("high").over(before), F.lit(True))
    rises = F.coalesce(F.col("low") >= F.lag("low").over(before), F.lit(True))
    return top.join(bottom, ["label", "rank"]).select(
        "label", "rank", (falls & rises).alias("ordered"), ((F.col("high") > 0) & (F.col("low") < 0)).alias("signed")
    )


def lr_report(spark: SparkSession, d: str) -> DataFrame:
    """Classes and supports of the report, whose averages agree with its accuracy, above the majority's."""
    docs = documents(spark, d, "lang", "text").withColumnRenamed("lang", "label")
    found = jobs.train_and_evaluate(docs, "doc_id")
    hits = found.accuracy.scalar()
    majority = found.matrix.groupBy("label").agg(F.sum("n").alias("n")).agg(F.max("n") / F.sum("n")).scalar()
    p, r, f1 = F.col("precision"), F.col("recall"), F.col("f1")
    mean = F.col("label") == "avg / total"
    harmonic = F.abs(f1 * (p + r) - 2 * p * r) < 1e-9
    return found.report.select(
        "label", "support", F.when(mean, (F.abs(r - hits) < 1e-9) & (hits > majority)).otherwise(harmonic).alias("agrees")
    )


def lr_quality(spark: SparkSession, d: str) -> DataFrame:
    """Two classes: the quality mark of the texts that carry one."""
    marked = documents(spark, d, "text").join(table(spark, d, "labels"), "doc_id")
    rows = marked.select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    train, test = split_by_hash(rows, "doc_id")
    # Six of seven texts bear one mark, so the most likely mark may well be the majority's.
    return _sound(linear.train(train).score(test)).drop("beats_majority")


def _feature_rows(spark: SparkSession, d: str, stages: list, vector: str) -> DataFrame:
    """``doc_id, term, value``: what the fitted feature stages make of the training texts."""
    train, _ = _parts(spark, d)
    many = tables.fit_features(train, stages, "doc_id")
    if many is not None:
        features, stored = many
        return features.values(stored, "doc_id").select("doc_id", "term", F.round("value", 6).alias("value"))
    fitted, rows = linear.fit_features(train, stages)
    terms = next(s.vocabulary for s in fitted.stages if isinstance(s, CountVectorizerModel))
    names = materialise(spark.createDataFrame(list(enumerate(terms)), "at INT, term STRING"), "feature-names")
    values = linear.sparse_rows(rows, ["doc_id"], vector)
    return values.join(broadcast_if_few(names), "at").select("doc_id", "term", F.round("value", 6).alias("value"))


def lr_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """The classifier's tf-idf, all terms."""
    return _feature_rows(spark, d, linear.tfidf_stages(), "features")


def lr_ngram(spark: SparkSession, d: str) -> DataFrame:
    """tf-idf of the 50,000 most frequent word trigrams without stop words."""
    stages = linear.tfidf_stages(ngram=3, stop_words=STOP_WORDS, vocab_size=MOST_FEATURES)
    return _feature_rows(spark, d, stages, "features")


def lr_char_ngram(spark: SparkSession, d: str) -> DataFrame:
    """tf-idf of the 50,000 most frequent character trigrams."""
    stages = linear.tfidf_stages(ngram=3, analyzer="char", vocab_size=MOST_FEATURES)
    return _feature_rows(spark, d, stages, "features")


def lr_ngram_predict(spark: SparkSession, d: str) -> DataFrame:
    """The classifier on the 50,000 most frequent word trigrams without stop words."""
    scored = _lr(spark, d, stages=linear.tfidf_stages(ngram=3, stop_words=STOP_WORDS, vocab_size=MOST_FEATURES))[1]
    # Most held-out texts share no trigram with the others; the majority's label is then the best answer.
    return _sound(scored).drop("beats_majority")


def lr_char_ngram_predict(spark: SparkSession, d: str) -> DataFrame:
    """The classifier on the 50,000 most frequent character trigrams."""
    return _sound(_lr(spark, d, stages=linear.tfidf_stages(ngram=3, analyzer="char", vocab_size=MOST_FEATURES))[1])


def lr_stats_union_predict(spark: SparkSession, d: str) -> DataFrame:
    """The classifier on statistics beside tf-idf."""
    return _sound(_lr(spark, d, stages=linear.union_stages(stats_weight=0.75, tfidf_weight=1.0))[1])


def lr_stats_union(spark: SparkSession, d: str) -> DataFrame:
    """The statistics block of the union beside its tf-idf block, each under its weight."""
    train, _ = _parts(spark, d)
    stages = linear.union_stages(stats_weight=0.75, tfidf_weight=2.0)
    many = tables.fit_features(train, stages, "doc_id")
    if many is not None:
        return _union_rows(*many)
    _, rows = linear.fit_features(train, stages)

    def width(vector: str) -> Column:
        raw = F.unwrap_udt(vector)
        return F.coalesce(raw["size"], F.size(raw["values"]))  # a dense vector states no size

    # Documents without terms have no tf-idf to be scaled to the block's weight.
    block, whole = vector_to_array("stats_block"), F.unwrap_udt("tfidf_block")
    length = F.sqrt(F.aggregate(whole["values"], F.lit(0.0), lambda acc, x: acc + x * x))
    return rows.select(
        "doc_id",
        *[F.round(F.get(block, F.lit(i)), 6).alias(c) for i, c in enumerate(STATS_COLUMNS)],
        F.round(length, 6).alias("tfidf_length"),
        (width("features") == F.size(block) + width("tfidf_block")).alias("is_union"),
    )


def _union_rows(features: tables.TermFeatures, stored: DataFrame) -> DataFrame:
    """The same where the terms are a table: the union has a row per entry of either block."""
    terms = features.values(stored).withColumn("of_terms", F.lit(True))
    union = terms.unionByName(features.others(stored).withColumn("of_terms", F.lit(False)))
    squares = F.sum(F.when(F.col("of_terms"), F.col("value") * F.col("value")))
    sums = union.groupBy("_row").agg(F.sqrt(squares).alias("length"), F.count("*").alias("entries"))
    held = F.size("_terms") + F.size(F.filter("_others", lambda e: e["value"] != 0))
    return stored.join(sums, "_row", "left").select(
        "doc_id",
        *[F.round(F.get("_others", F.lit(i))["value"], 6).alias(c) for i, c in enumerate(STATS_COLUMNS)],
        F.round(F.coalesce("length", F.lit(0.0)), 6).alias("tfidf_length"),
        (F.coalesce("entries", F.lit(0)) == held).alias("is_union"),
    )


def grid_search(spark: SparkSession, d: str) -> DataFrame:
    """Two points on every axis but the cost; every combination has an accuracy, and the best one is
    above the share of the most frequent label."""
    docs = documents(spark, d, "lang", "text").withColumnRenamed("lang", "label")
    found = linear.grid_search(
        docs, "doc_id", vocab_sizes=(500, 1000), ngrams=(2, 3), weights=((1.0, 0.75), (0.75, 1.0)),
        costs=(10.0,), penalties=("l1", "l2"), analyzer="char", folds=2,
    )[1]
    majority = docs.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n") / F.sum("n")).scalar()
    best = F.max("accuracy").over(Window.partitionBy())  # a row per combination
    return found.select(
        "ngram", "vocab_size", "cost", "penalty", "tfidf_weight", "stats_weight",
        F.col("accuracy").between(0, 1).alias("has_accuracy"),
        (best > majority).alias("best_beats_majority"),
    )


def predict_into_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The predictions for the texts held out from training, in their catalog rows."""
    key = F.col("doc_id").cast("string").alias("isbn")
    catalog = documents(spark, d, "lang").select(
        key, F.col("lang").alias("gtype"), F.lit(None).cast("string").alias("genres_predicted")
    )
    return linear.predict_into_catalog(nb_predict(spark, d).select(key, "prediction"), catalog)


QUERIES = {
    "nb_scores": nb_scores,
    "nb_predict": nb_predict,
    "nb_argmax": nb_argmax,
    "nb_proba": nb_proba,
    "nb_tfidf_scores": nb_tfidf_scores,
    "write_probabilities": write_probabilities,
    "lr_saved": lr_saved,
    "nb_top_features": nb_top_features,
    "nb_bottom_features": nb_bottom_features,
    "confusion_matrix": confusion_matrix,
    "confusion_matrix_normalised": confusion_matrix_normalised,
    "confusion_matrix_wide": confusion_matrix_wide,
    "classification_report": classification_report,
    "accuracy": accuracy,
    "distinct_labels": distinct_labels,
    "nb_mllib": nb_mllib,
    "lr_tfidf": lr_tfidf,
    "lr_predict": lr_predict,
    "lr_proba": lr_proba,
    "lr_multinomial": lr_multinomial,
    "lr_top_features": lr_top_features,
    "lr_bottom_features": lr_bottom_features,
    "lr_table_predict": lr_table_predict,
    "lr_table_optimum": lr_table_optimum,
    "lr_table_top_features": lr_table_top_features,
    "lr_optimum": lr_optimum,
    "lr_report": lr_report,
    "lr_quality": lr_quality,
    "lr_stats_union": lr_stats_union,
    "lr_ngram": lr_ngram,
    "lr_char_ngram": lr_char_ngram,
    "lr_stats_union_predict": lr_stats_union_predict,
    "lr_ngram_predict": lr_ngram_predict,
    "lr_char_ngram_predict": lr_char_ngram_predict,
    "grid_search": grid_search,
    "predict_into_catalog": predict_into_catalog,
}

_MODEL_SQL = f"""
{TERM_COUNTS_SQL},
model as (select term, lang as label, sum(tf) as n from counts where {BUCKET_SQL} >= 25 group by all),
vocabulary as (select distinct term from model),
mass as (
  select label, sum(n) + (select count(*) from vocabulary) as mass from model group by label),
prior as (
  select lang as label, ln(count(*) / (1.0e0 * sum(count(*)) over ())) as prior
  from documents where {BUCKET_SQL} >= 25 group by lang)"""

_SCORING_SQL = f"""
test as (select doc_id, lang from documents where {BUCKET_SQL} < 25),
known as (select c.doc_id, c.term, c.tf from counts c join vocabulary v on c.term = v.term
          where c.doc_id in (select doc_id from test)),
lens as (select doc_id, sum(tf) as len from known group by doc_id),
hits as (
  select k.doc_id, m.label, sum(k.tf * ln(m.n + 1.0e0)) as s
  from known k join model m on k.term = m.term group by all),
scores as (
  select t.doc_id, t.lang as truth, p.label,
         p.prior + coalesce(h.s, 0) - coalesce(l.len, 0) * ln(m.mass::double) as score
  from test t cross join prior p join mass m on m.label = p.label
  left join lens l on l.doc_id = t.doc_id
  left join hits h on h.doc_id = t.doc_id and h.label = p.label),
predicted as (
  select doc_id, truth as label, label as prediction from (
    select *, row_number() over (partition by doc_id order by score desc, label) as rn from scores)
  where rn = 1)"""

_SCORES_SQL = f"{_MODEL_SQL}, {_SCORING_SQL}"

# The same scores where a document's term counts as its tf-idf weight.
_TFIDF_MODEL_SQL = _MODEL_SQL.replace(
    TERM_COUNTS_SQL,
    f"""
{TERM_COUNTS_SQL.replace("counts as", "raw_counts as")},
idf as (
  select term,
         ln((1 + (select count(*) from documents where {BUCKET_SQL} >= 25)) / (1.0e0 + count(*))) + 1 as idf
  from raw_counts where {BUCKET_SQL} >= 25 group by term),
weighted as (select doc_id, lang, term, tf * idf as w from raw_counts join idf using (term)),
counts as (
  select doc_id, lang, term, w / sqrt(sum(w * w) over (partition by doc_id)) as tf from weighted)""",
)

_MATRIX_SQL = f"""
{_SCORES_SQL},
seen as (select label as c from predicted union select prediction from predicted),
matrix as (
  select a.c as label, b.c as prediction, count(p.doc_id)::bigint as n
  from seen a cross join seen b left join predicted p on p.label = a.c and p.prediction = b.c
  group by all)"""

_PROBA_SQL = f"""
with {_SCORES_SQL},
e as (select doc_id, label, exp(score - max(score) over (partition by doc_id)) as e from scores)
select doc_id, label, round(e / sum(e) over (partition by doc_id), 4) as probability from e"""

_FEATURES_SQL = f"""
{_MODEL_SQL},
weights as (
  select m.label, v.term,
         round(ln(coalesce(x.n, 0) + 1.0e0) - ln(m.mass::double), 6) as weight
  from vocabulary v cross join mass m left join model x on x.term = v.term and x.label = m.label)"""

# MLlib smooths the class prior as well.
_MLLIB_SQL = _SCORES_SQL.replace(
    "ln(count(*) / (1.0e0 * sum(count(*)) over ())) as prior",
    "ln((count(*) + 1) / (1.0e0 * (sum(count(*)) over () + count(*) over ()))) as prior",
)

_TEST_SQL = f"""
test as (select doc_id, lang as label from documents where {BUCKET_SQL} < 25),
classes as (select count(distinct lang) as n_labels from documents where {BUCKET_SQL} >= 25)"""

_INFORMED = "true as sums_to_one, true as non_negative, true as is_mode, true as informed"
_SOUND = f"{_INFORMED}, true as beats_majority"

_RANKS_SQL = f"""
select label, rank, true as ordered, true as known, true as signed
from (select distinct lang as label from documents where {BUCKET_SQL} >= 25) l,
     (select unnest(generate_series(1, 25)) as rank) r"""


def _values_sql(counts: str, size: int | None) -> str:
    cut = f"order by sum(tf) desc, term limit {size}" if size else ""
    return f"""
{counts},
train as (select c.doc_id, c.term, c.tf from counts c join documents using (doc_id) where {BUCKET_SQL} >= 25),
kept as (select term, count(*) as df from train group by term {cut}),
w as (
  select doc_id, term, tf * (ln((1 + (select count(*) from documents where {BUCKET_SQL} >= 25)) / (1.0e0 + df)) + 1) as w
  from train join kept using (term)),
val as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as value from w)"""


def _weights_sql(counts: str, size: int | None) -> str:
    """tf-idf of the training texts over all their terms, or the most frequent."""
    return f"with {_values_sql(counts, size)} select doc_id, term, round(value, 6) as value from val"


def _zero_sql(name: str, rate: str) -> str:
    """Norm per class of the gradient that weights of zero leave, intercept included."""
    return f"""
residual_{name} as (
  select d.doc_id, l.label, ({rate} - (d.lang = l.label)::int) / (select count(*) from learned) as r
  from learned d, (select distinct lang as label from learned) l),
pull_{name} as (select label, term, sum(value * r) as g from val join residual_{name} using (doc_id) group by all),
zero_{name} as (
  select label, sqrt((select sum(g * g) from pull_{name} p where p.label = r.label) + sum(r) * sum(r)) as at_zero
  from residual_{name} r group by label)"""


_ZERO_SQL = f"""
{_values_sql(TERM_COUNTS_SQL, None)},
learned as (select doc_id, lang from documents where {BUCKET_SQL} >= 25),
{_zero_sql("ovr", "0.5e0")},
{_zero_sql("multinomial", "1.0e0 / (select count(distinct lang) from learned)")}"""


_WORD_TRIGRAMS_SQL = rf"""
tokens as (
  select doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'),
    lambda x: x not in ({sql_list(STOP_WORDS)})) as ts
  from documents),
counts as (
  select doc_id, term, count(*) as tf
  from (select doc_id, unnest([ts[i] || ' ' || ts[i + 1] || ' ' || ts[i + 2] for i in generate_series(1, len(ts) - 2)]) as term
        from tokens) group by all)"""

_CHAR_TRIGRAMS_SQL = r"""
flat as (select doc_id, string_split(regexp_replace(lower(text), '[\s\x0b][\s\x0b]+', ' ', 'g'), '') as cs from documents),
counts as (
  select doc_id, term, count(*) as tf
  from (select doc_id, unnest([cs[i] || cs[i + 1] || cs[i + 2] for i in generate_series(1, len(cs) - 2)]) as term from flat)
  group by all)"""

ORACLES = {
    "nb_scores": f"with {_SCORES_SQL} select doc_id, label, round(score, 4) as score from scores",
    "nb_tfidf_scores": f"""
with {_TFIDF_MODEL_SQL}, {_SCORING_SQL}
select doc_id, label, round(score, 4) as score from scores""",
    "nb_predict": f"with {_SCORES_SQL} select doc_id, label, prediction from predicted",
    "nb_argmax": f"with {_SCORES_SQL} select doc_id, prediction from predicted",
    "nb_proba": _PROBA_SQL,
    "write_probabilities": _PROBA_SQL,
    "nb_top_features": f"""
with {_FEATURES_SQL}
select * from (
  select label, term, weight, row_number() over (partition by label order by weight desc, term) as rank
  from weights) where rank <= 25""",
    "nb_bottom_features": f"""
with {_FEATURES_SQL}
select * from (
  select label, term, weight, row_number() over (partition by label order by weight, term) as rank
  from weights) where rank <= 25""",
    "confusion_matrix": f"with {_MATRIX_SQL} select label, prediction, n from matrix",
    "confusion_matrix_normalised": f"""
with {_MATRIX_SQL}
select label, prediction, n,
       round(n / nullif(sum(n) over (partition by label), 0)::double, 6) as share
from matrix""",
    "confusion_matrix_wide": f"""
with {_MATRIX_SQL}
select label, {", ".join(f"max(n) filter (prediction = '{c}') as {c}" for c in ("de", "en", "es", "fr"))}
from matrix group by label""",
    "classification_report": f"""
with {_MATRIX_SQL},
per_class as (
  select c as label,
         sum(case when label = c and prediction = c then n else 0 end) as tp,
         sum(case when label = c then n else 0 end) as support,
         sum(case when prediction = c then n else 0 end) as guessed
  from seen, matrix group by c),
pr as (
  select label, coalesce(tp / nullif(guessed, 0)::double, 0) as p,
         coalesce(tp / nullif(support, 0)::double, 0) as r, support from per_class),
report as (
  select label, p as precision, r as recall, coalesce(2 * p * r / nullif(p + r, 0), 0) as f1, support from pr)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
       support::bigint as support from report
union all
select 'avg / total', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       sum(support)::bigint
from report""",
    "accuracy": f"""
with {_SCORES_SQL}
select avg(case when label = prediction then 1.0e0 else 0.0e0 end) as accuracy from predicted""",
    "distinct_labels": "select distinct lang from documents",
    "nb_mllib": f"with {_MLLIB_SQL} select doc_id, label, prediction from predicted",
    "lr_saved": f"with {_TEST_SQL} select doc_id, label, true as same from test",
    "lr_predict": f"with {_TEST_SQL} select doc_id, label, n_labels, {_SOUND} from test, classes",
    "lr_multinomial": f"with {_TEST_SQL} select doc_id, label, n_labels, {_SOUND} from test, classes",
    "lr_stats_union_predict": f"with {_TEST_SQL} select doc_id, label, n_labels, {_SOUND} from test, classes",
    "lr_ngram_predict": f"with {_TEST_SQL} select doc_id, label, n_labels, {_INFORMED} from test, classes",
    "lr_char_ngram_predict": f"with {_TEST_SQL} select doc_id, label, n_labels, {_SOUND} from test, classes",
    "lr_table_predict": f"with {_TEST_SQL} select doc_id, label, n_labels, {_SOUND} from test, classes",
    "lr_table_optimum": f"""
with {_ZERO_SQL}
select label, round(at_zero, 6) as at_zero, true as at_optimum, (select count(*) from kept) as n_terms from zero_ovr""",
    "lr_optimum": f"""
with {_ZERO_SQL}
select 'ovr' as strategy, label, round(at_zero, 6) as at_zero, true as is_trained from zero_ovr
union all select 'multinomial', label, round(at_zero, 6), true from zero_multinomial""",
    "lr_table_top_features": _RANKS_SQL.replace("true as known, ", ""),
    "lr_proba": f"""
with {_TEST_SQL}
select doc_id, c.label, true as is_probability, true as favoured
from test, (select distinct lang as label from documents where {BUCKET_SQL} >= 25) c""",
    "lr_top_features": _RANKS_SQL,
    "lr_bottom_features": _RANKS_SQL,
    "lr_report": f"""
with {_TEST_SQL}
select label, count(*) as support, true as agrees from test group by label
union all select 'avg / total', count(*), true from test""",
    "lr_quality": f"""
select doc_id, quality::varchar as label, 2::bigint as n_labels, {_INFORMED}
from documents join labels using (doc_id) where {BUCKET_SQL} < 25""",
    "lr_tfidf": _weights_sql(TERM_COUNTS_SQL, None),
    "lr_ngram": _weights_sql(_WORD_TRIGRAMS_SQL, MOST_FEATURES),
    "lr_char_ngram": _weights_sql(_CHAR_TRIGRAMS_SQL, MOST_FEATURES),
    "lr_stats_union": rf"""
with s as (
  select doc_id, length(text)::double as l, regexp_extract_all(text, '[^\s.!?][^.!?]*[.!?]*') as ss,
         len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) as n_terms
  from documents where {BUCKET_SQL} >= 25),
v as (
  select doc_id, l, len(ss)::double as n, n_terms,
         case when len(ss) > 0 then list_sum([length(x) for x in ss])::double / len(ss) else 0 end as m from s)
select doc_id, round(0.75 * l / (select stddev_samp(l) from v), 6) as length,
       round(0.75 * n / (select stddev_samp(n) from v), 6) as num_sentences,
       round(0.75 * m / (select stddev_samp(m) from v), 6) as avg_sentence_length,
       case when n_terms > 0 then 2.0 else 0.0 end::double as tfidf_length, true as is_union
from v""",
    "grid_search": """
select ngram::int as ngram, vocab_size::int as vocab_size, 10.0::double as cost, penalty,
       t::double as tfidf_weight, s::double as stats_weight, true as has_accuracy, true as best_beats_majority
from (values (2), (3)) a(ngram), (values (500), (1000)) b(vocab_size), (values ('l1'), ('l2')) c(penalty),
     (values (1.0, 0.75), (0.75, 1.0)) e(t, s)""",
    "predict_into_catalog": f"""
with {_SCORES_SQL}
select d.doc_id::varchar as isbn, d.lang as gtype, p.prediction as genres_predicted
from documents d left join predicted p on p.doc_id = d.doc_id""",
}
