"""Logistic regression over tf-idf features, with MLlib."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    NaiveBayes,
    OneVsRest,
    OneVsRestModel,
)
from pyspark.ml.feature import (
    CountVectorizerModel,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StandardScaler,
    StopWordsRemover,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tomeweave.functions.text import WORD, hash_bucket, let
from tomeweave.operators import search, tables
from tomeweave.operators.stages import STATS_COLUMNS, BlockWeight, DocumentStats, SmoothedIdf, TermVocabulary
from tomeweave.sources.workspace import materialise

def tfidf_stages(
    text: str = "text",
    output: str = "features",
    vocab_size: int | None = None,
    ngram: int = 1,
    analyzer: str = "word",
    stop_words: Sequence[str] = (),
) -> list:
    """Tokens -> counts -> idf -> unit length, as pipeline stages.

    All terms count unless ``vocab_size`` names a number of the most frequent.
    """
    if analyzer == "char":
        flat = rf"regexp_replace(lower(`{text}`), r'\s\s+', ' ')"
        grams = rf"regexp_extract_all({flat}, r'(?s)(?=(.{{{ngram}}})).', 1)"
        stages: list = [SQLTransformer(statement=f"SELECT *, {grams} AS grams FROM __THIS__")]
        column = "grams"
    else:
        stages = [RegexTokenizer(inputCol=text, outputCol="tokens", pattern=WORD, gaps=False)]
        column = "tokens"
        if stop_words:
            stages.append(
                StopWordsRemover(inputCol=column, outputCol="kept", stopWords=list(stop_words))
            )
            column = "kept"
        if ngram > 1:
            stages.append(NGram(n=ngram, inputCol=column, outputCol="grams"))
            column = "grams"
    return [
        *stages,
        TermVocabulary(inputCol=column, outputCol="counts", vocabSize=vocab_size or 0),
        SmoothedIdf(inputCol="counts", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol=output, p=2.0),
    ]


def union_stages(
    text: str = "text", output: str = "features", stats_weight: float = 1.0, tfidf_weight: float = 1.0, **tfidf
) -> list:
    """Document statistics beside tf-idf, each block under its own weight.

    The statistics are brought to unit deviation first; raw lengths would drown the terms.
    """
    return [
        DocumentStats(inputCol=text),
        VectorAssembler(inputCols=list(STATS_COLUMNS), outputCol="stats_raw"),
        StandardScaler(inputCol="stats_raw", outputCol="stats_unit", withMean=False, withStd=True),
        BlockWeight(inputCol="stats_unit", outputCol="stats_block", weight=stats_weight),
        *tfidf_stages(text, "tfidf", **tfidf),
        BlockWeight(inputCol="tfidf", outputCol="tfidf_block", weight=tfidf_weight),
        VectorAssembler(inputCols=["stats_block", "tfidf_block"], outputCol=output),
    ]


def classifier(
    n: int,
    strategy: str = "ovr",
    c: float = 1.0,
    penalty: str = "l2",
    label: str = "label_index",
    max_iter: int = 100,
    tol: float = 1e-4,
    parallelism: int = 4,
) -> Estimator:
    """Unscaled logistic regression whose penalty equals cost ``c`` over ``n`` rows.

    ``ovr`` fits one model per class against the rest, ``multinomial`` one softmax model.
    """
    base = LogisticRegression(
        featuresCol="features",
        labelCol=label,
        regParam=1.0 / (c * max(n, 1)),
        elasticNetParam=1.0 if penalty == "l1" else 0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
        family="multinomial" if strategy == "multinomial" else "binomial",
    )
    if strategy == "multinomial":
        return base
    return OneVsRest(classifier=base, featuresCol="features", labelCol=label, parallelism=parallelism)


def naive_bayes(smoothing: float = 1.0, label: str = "label_index") -> NaiveBayes:
    """MLlib's twin of the relational model; it also smooths the class prior."""
    return NaiveBayes(featuresCol="counts", labelCol=label, modelType="multinomial", smoothing=smoothing)


@dataclass(frozen=True)
class TextClassifier:
    """Fitted once; labels, probabilities and coefficients all come from the same fit."""

    labels: tuple[str, ...]
    features: PipelineModel
    model: LogisticRegressionModel | OneVsRestModel

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (a label) and ``proba``, label and probability per class."""
        names = F.array(*[F.lit(x) for x in self.labels])
        out = self.model.transform(self.features.transform(df))
        best = F.get(names, F.col("prediction").cast("int"))
        return out.select(
            *df.columns,
            best.alias("prediction"),
            F.zip_with(
                names,
                self._probabilities(),
                lambda x, p: F.struct(x.alias("label"), p.alias("probability")),
            ).alias("proba"),
        )

    def _probabilities(self) -> Column:
        if isinstance(self.model, LogisticRegressionModel):
            return vector_to_array("probability")
        sigmoid = F.transform(vector_to_array("rawPrediction"), lambda m: 1.0 / (1.0 + F.exp(-m)))
        return let(
            sigmoid,
            lambda ps: F.transform(
                ps, lambda p: p / F.aggregate(ps, F.lit(0.0), lambda total, x: total + x)
            ),
        )

    def coefficients(self, spark) -> DataFrame:
        """``label, term, weight`` rows, laid out by the executors from one vector per label."""
        if isinstance(self.model, LogisticRegressionModel):
            matrix = self.model.coefficientMatrix.toArray()
        else:
            matrix = [m.coefficients for m in self.model.models]
        rows = [(label, Vectors.dense(v)) for label, v in zip(self.labels, matrix)]
        vectors = spark.createDataFrame(rows, StructType().add("label", "string").add("v", VectorUDT()))
        weights = vectors.select("label", F.posexplode(vector_to_array("v")).alias("at", "weight"))
        names = spark.createDataFrame([(self.feature_names(),)], "names ARRAY<STRING>")
        terms = names.select(F.posexplode("names").alias("at", "term"))
        return weights.join(terms, "at").select("label", "term", "weight")

    def feature_names(self) -> list[str]:
        names: list[str] = []
        for stage in self.features.stages:
            if isinstance(stage, DocumentStats):
                names += [f"stats:{c}" for c in STATS_COLUMNS]
            elif hasattr(stage, "vocabulary"):
                names += list(stage.vocabulary)
        return names


def train(
    train_rows: DataFrame,
    label: str = "label",
    text: str = "text",
    stages: Sequence | None = None,
    strategy: str = "ovr",
    c: float = 1.0,
    penalty: str = "l2",
    max_iter: int = 100,
) -> TextClassifier | tables.TableTextClassifier:
    """Fit features and classifier on labelled texts. Class indices follow label order.

    Where all terms count and they are more than ``tables.DRIVER_TERMS``, terms, features and
    coefficients are tables (L2 only), else MLlib's vectors.
    """
    stages = tfidf_stages() if stages is None else stages
    sizes = {r[0]: r[1] for r in train_rows.groupBy(label).count().collect()}
    n, labels = sum(sizes.values()), sorted(sizes)
    indexer = StringIndexerModel.from_labels(labels, inputCol=label, outputCol="label_index")
    if penalty == "l2":
        many = tables.train(train_rows, labels, label, stages, strategy, c, max_iter)
        if many is not None:
            return many
    features, ready = fit_features(indexer.transform(train_rows), stages, text)
    # Attribute names of every term in the schema would travel with each task of each step.
    vectors = F.col("features").alias("features", metadata={})
    index = F.col("label_index").alias("label_index", metadata={})
    ready = materialise(ready.select(vectors, index), "features").persist()
    try:
        model = classifier(n, strategy, c, penalty, max_iter=max_iter).fit(ready)
    finally:
        ready.unpersist()
    return TextClassifier(tuple(labels), features, model)


def fit_features(
    rows: DataFrame, stages: Sequence, text: str = "text"
) -> tuple[PipelineModel, DataFrame]:
    """Fit the stages in turn; the texts are read for the vocabulary and once more for counts.

    The counts are written to the shared folder, and later stages fit on them: they are far
    smaller than the texts, and a lost executor does not send the fit back to the tokenizer.
    Stages that read the text stand before the vectorizer.
    """
    fitted: list[Transformer] = []
    for stage in stages:
        model = stage.fit(rows) if isinstance(stage, Estimator) else stage
        fitted.append(model)
        rows = model.transform(rows)
        if isinstance(model, CountVectorizerModel):
            spent = [f.name for f in rows.schema if f.dataType.simpleString() == "array<string>"]
            rows = materialise(rows.drop(text, *spent), "counts")
    return PipelineModel(fitted), rows


def sparse_rows(df: DataFrame, keep: Sequence[str], vector: str) -> DataFrame:
    """``keep..., at, value`` of a vector column, stored entries only.

    Read from the vector's physical struct, so a sparse one is never laid out over its width.
    """
    raw = F.unwrap_udt(vector)
    at = F.coalesce(raw["indices"], F.sequence(F.lit(0), F.size(raw["values"]) - 1))
    entries = F.arrays_zip(at.alias("at"), raw["values"].alias("value"))
    return df.select(*keep, F.inline(entries)).where("value <> 0")


def intercept_rows(model: TextClassifier | tables.TableTextClassifier, spark) -> DataFrame:
    """``label, intercept`` rows."""
    fitted = model.model
    if isinstance(model, tables.TableTextClassifier):
        return fitted.intercept_rows()
    if isinstance(fitted, LogisticRegressionModel):
        values = fitted.interceptVector.toArray().tolist()
    else:
        values = [m.intercept for m in fitted.models]
    return spark.createDataFrame(list(zip(model.labels, values)), "label STRING, intercept DOUBLE")


def probability_rows(scored: DataFrame, key: str, proba: str = "proba") -> DataFrame:
    """``key, label, probability``: one row per document and class.

    No array is empty; the outer form keeps the optimizer from testing that by computing the
    whole model a second time in a filter.
    """
    return scored.select(key, F.inline_outer(proba))


def grid_search(
    rows: DataFrame,
    key: str,
    label: str = "label",
    text: str = "text",
    vocab_sizes: Sequence[int] = (5000, 10000, 25000, 50000),
    ngrams: Sequence[int] = (1,),
    weights: Sequence[tuple[float, float] | None] = (None,),
    costs: Sequence[float] = (0.1, 1.0, 10.0),
    penalties: Sequence[str] = ("l1", "l2"),
    analyzer: str = "word",
    folds: int = 3,
    max_iter: int = 100,
) -> tuple[CrossValidatorModel, DataFrame]:
    """Cross-validated accuracy of every combination; folds come from a hash of the key.

    ``weights`` are pairs of the tf-idf block's and the statistics block's weight, None for
    tf-idf alone. Vocabularies are made once for an n-gram size and fold, and all combinations are
    fitted in the same passes, as many at a time as the driver holds.
    """
    spark = rows.sparkSession
    n = rows.count() * (folds - 1) // folds
    indexer = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc")
    folded = (
        indexer.fit(rows)
        .transform(rows)
        .withColumn("_fold", hash_bucket(F.col(key), folds).cast("int"))
    )
    classes = folded.agg(F.max("label_index")).first()[0]
    classes = 0 if classes is None else int(classes) + 1
    combinations = list(itertools.product(vocab_sizes, costs, penalties))
    pipelines, settings, train, test, idfs = [], [], [], [], []
    for gram in ngrams:
        tokens = None
        for pair in weights:
            options = {"text": text, "ngram": gram, "analyzer": analyzer}
            if pair is None:
                stages = tfidf_stages(**options)
            else:
                stages = union_stages(tfidf_weight=pair[0], stats_weight=pair[1], **options)
            first = next(i for i, s in enumerate(stages) if isinstance(s, TermVocabulary))
            # Tokens and statistics do not depend on the parameters: they are built once for all fits.
            before = [s for s in stages[:first] if isinstance(s, Transformer)]
            if tokens is None or pair and "stats_raw" not in tokens.columns:
                wanted = [stages[first].getInputCol(), *(["stats_raw"] if pair else []), "label_index", "_fold"]
                tokens = materialise(PipelineModel(before).transform(folded).select(*wanted), "tokens")
            pipelines.append((gram, pair, [s for s in stages if s not in before], stages[first], tokens))
        vectorizer, width = stages[first], len(STATS_COLUMNS)
        for fold in range(folds):
            rows_of = [tokens.where(F.col("_fold") != fold), tokens.where(F.col("_fold") == fold)]
            counter = vectorizer.copy({vectorizer.vocabSize: max(vocab_sizes)}).fit(rows_of[0])
            if "stats_raw" in tokens.columns:
                unit = StandardScaler(inputCol="stats_raw", outputCol="stats_unit", withMean=False, withStd=True).fit(rows_of[0])
                counted = [unit.transform(counter.transform(r)).withColumn("stats", vector_to_array("stats_unit")) for r in rows_of]
            else:
                width = 0
                counted = [counter.transform(r).withColumn("stats", F.array().cast("array<double>")) for r in rows_of]
            group, many = len(idfs), len(counter.vocabulary)
            blocks = [search.packed(r.withColumnRenamed(vectorizer.getOutputCol(), "counts"), group, many, "blocks") for r in counted]
            train.append(blocks[0])
            test.append(blocks[1])
            idf = SmoothedIdf(inputCol=vectorizer.getOutputCol(), outputCol="weighted").fit(counter.transform(rows_of[0]))
            idfs.append(idf.getScalingVec().toArray())
            for pair, (size, cost, penalty) in itertools.product(weights, combinations):
                blocks_of = pair or (1.0, None)
                settings.append(search.Setting(group, min(size, many), *blocks_of, 1.0 / (cost * max(n, 1)), penalty == "l1"))
    found = search.accuracies(train, test, idfs, settings, classes, width, max_iter)
    best, results, at = None, [], 0
    for _ in ngrams:
        here = [found[at + i * len(weights) * len(combinations) :][: len(weights) * len(combinations)] for i in range(folds)]
        at += folds * len(weights) * len(combinations)
        means = [sum(of) / folds for of in zip(*here)]
        for i in range(len(weights)):
            some = means[i * len(combinations) :][: len(combinations)]
            gram, pair, after, vectorizer, ready = pipelines[len(results) // len(combinations)]
            for (size, cost, penalty), score in zip(combinations, some):
                results.append((gram, size, float(cost), penalty, *(pair or (None, None)), float(score)))
            if best is None or max(some) > max(best[0]):
                best = (some, after, vectorizer, ready)
    # The best combination is fitted on all rows.
    metrics, after, vectorizer, ready = best
    size, cost, penalty = combinations[metrics.index(max(metrics))]
    lr = classifier(n, "multinomial", cost, penalty, max_iter=max_iter)
    fitted = Pipeline(stages=[*after, lr]).fit(ready, {vectorizer.vocabSize: size})
    best = CrossValidatorModel(fitted, metrics)
    schema = (
        "ngram INT, vocab_size INT, cost DOUBLE, penalty STRING, tfidf_weight DOUBLE, "
        "stats_weight DOUBLE, accuracy DOUBLE"
    )
    return best, spark.createDataFrame(results, schema)


def predict_into_catalog(predictions: DataFrame, catalog: DataFrame, key: str = "isbn") -> DataFrame:
    """The catalog with ``genres_predicted`` filled from ``key, prediction`` rows of any model."""
    predicted = predictions.select(key, F.col("prediction").alias("_new"))
    return catalog.join(predicted, key, "left").select(
        *[c for c in catalog.columns if c != "genres_predicted"],
        F.coalesce("_new", "genres_predicted").alias("genres_predicted"),
    )
