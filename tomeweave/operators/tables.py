"""The text classifier over a vocabulary of any size: terms, idf, features and weights are tables.

The twin of ``linear``'s features and models, which keep them on the driver. It reads the same
stages: those up to the tokens run as they are, the vocabulary and what follows it become joins
and sums over ``term`` rows. Rows are told apart by a number of their own, so keys may repeat or
be null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.functions.text import run_lengths
from tomeweave.operators import logistic
from tomeweave.operators.stages import STATS_COLUMNS, BlockWeight, DocumentStats, SmoothedIdf, TermVocabulary
from tomeweave.operators.terms import idf_of, tfidf
from tomeweave.sources.workspace import broadcast_if_few, discard, materialise

# More terms than these are kept in tables. A fit on the driver holds some twenty vectors of that
# length per class at a time, and every step sends it one.
DRIVER_TERMS = 100_000

# Part of an untrained model's gradient at which a fit ends; MLlib's 100 steps leave 0.1 to 0.2.
TOLERANCE = 1e-3


@dataclass(frozen=True)
class TermFeatures:
    """Fitted features. ``lead`` makes the ``tokens`` and the other ``blocks`` of a text; ``idf`` is a
    stored table ``term, df, idf``; the tf-idf of a text has the length ``weight``."""

    lead: PipelineModel
    tokens: str
    idf: DataFrame
    weight: float
    blocks: tuple[str, ...]

    def documents(self, rows: DataFrame, *keep: str) -> DataFrame:
        """Stored: ``_row``, a number of its own; ``keep``; ``_terms``, counted; ``_others``, named values."""
        return _documents(self.lead, self.tokens, self.blocks, rows, keep)

    def values(self, stored: DataFrame, *keep: str) -> DataFrame:
        """``_row, keep..., term, value``: tf-idf of the stored documents."""
        counts = stored.select("_row", *keep, F.inline("_terms"))
        found = tfidf(counts, self.idf, "_row")
        return found.select("_row", *keep, "term", (F.col("tfidf") * self.weight).alias("value"))

    def others(self, stored: DataFrame, *keep: str) -> DataFrame:
        """The same of the other blocks' entries."""
        return stored.select("_row", *keep, F.inline("_others")).where("value <> 0")


def _documents(lead: Transformer, tokens: str, blocks: Sequence[str], rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    ready = lead.transform(rows.select(F.monotonically_increasing_id().alias("_row"), *rows.columns))
    named = []
    for block in blocks:
        # A block is as short as the statistics are; the vocabulary is none.
        at = F.transform(vector_to_array(block), lambda x, i: F.struct(_name(block, i).alias("term"), x.alias("value")))
        named.append(at)
    others = F.concat(*named) if named else F.array().cast("array<struct<term:string,value:double>>")
    return materialise(
        ready.select("_row", *keep, run_lengths(F.col(tokens)).alias("_terms"), others.alias("_others")), "documents"
    )


def _name(block: str, at):
    if block == "stats_block":
        return F.get(F.array(*[F.lit(f"stats:{c}") for c in STATS_COLUMNS]), at)
    return F.concat(F.lit(f"{block}:"), at.cast("string"))


def _parts(stages: Sequence) -> tuple[list, TermVocabulary, float, tuple[str, ...]] | None:
    """Stages before the vocabulary, it, the tf-idf block's weight and the other blocks.

    None unless the stages are tf-idf of all terms, weighted or not, with other blocks or without.
    """
    at = next((i for i, s in enumerate(stages) if isinstance(s, TermVocabulary)), None)
    if at is None or stages[at].getOrDefault(stages[at].vocabSize):
        return None
    lead, vocabulary, tail = list(stages[:at]), stages[at], list(stages[at + 1 :])
    if len(tail) < 2 or not isinstance(tail[0], SmoothedIdf) or not isinstance(tail[1], Normalizer) or tail[1].getP() != 2.0:
        return None
    column, weight, blocks = vocabulary.getOutputCol(), 1.0, ()
    for stage in tail:
        if isinstance(stage, VectorAssembler) and stage is tail[-1] and column in stage.getInputCols():
            blocks = tuple(c for c in stage.getInputCols() if c != column)
        elif not isinstance(stage, (SmoothedIdf, Normalizer, BlockWeight)) or stage.getInputCol() != column:
            return None
        elif isinstance(stage, BlockWeight):
            weight *= stage.getOrDefault(stage.weight)
        column = stage.getOutputCol()
    return lead, vocabulary, weight, blocks


def fit_features(rows: DataFrame, stages: Sequence, *keep: str) -> tuple[TermFeatures, DataFrame] | None:
    """The fitted features and the stored documents of ``rows``; None for stages of another kind
    and for no more than ``DRIVER_TERMS`` terms, which ``linear`` fits in vectors."""
    parts = _parts(stages)
    if parts is None:
        return None
    before, vocabulary, weight, blocks = parts
    fitted, ready = [], rows
    for stage in before:
        fitted.append(stage.fit(ready) if isinstance(stage, Estimator) else stage)
        ready = fitted[-1].transform(ready)
    lead, tokens = PipelineModel(fitted), vocabulary.getInputCol()
    stored = _documents(lead, tokens, blocks, rows, keep)
    idf = idf_of(stored.select(F.inline("_terms")).groupBy("term").agg(F.count("*").alias("df")), stored)
    if idf.limit(DRIVER_TERMS + 1).count() <= DRIVER_TERMS:
        discard(idf)
        discard(stored)
        return None
    return TermFeatures(lead, tokens, idf, weight, blocks), stored


@dataclass(frozen=True)
class TableTextClassifier:
    """What ``linear.TextClassifier`` is, its features and coefficients being tables."""

    labels: tuple[str, ...]
    features: TermFeatures
    model: logistic.TableModel
    strategy: str

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (a label) and ``proba``, label and probability per class.

        A document's sums run over its terms in their order: the same model gives the same bits.
        """
        classes, own = range(len(self.labels)), [F.lit(x) for x in self.model.intercepts]
        stored = self.features.documents(df, *df.columns)
        # Few: the entries of the other blocks.
        short = {
            r["term"]: r for r in self.model.weights.where(F.col("term").isin(self._other_names())).collect()
        } if self.features.blocks else {}
        table = self.model.weights.join(self.features.idf, "term").select("term", "idf", *[f"w{k}" for k in classes])
        table = materialise(table, "scoring")
        counts = stored.select("_row", F.posexplode("_terms").alias("at", "e")).select("_row", "at", "e.term", "e.tf")
        known = counts.join(broadcast_if_few(table), "term")
        weighted = (F.col("tf") * F.col("idf")).alias("x")
        entries = F.sort_array(F.collect_list(F.struct("at", weighted, *[f"w{k}" for k in classes])))
        sums = known.groupBy("_row").agg(entries.alias("_es")).select(
            "_row",
            F.sqrt(F.aggregate("_es", F.lit(0.0), lambda acc, e: acc + e["x"] * e["x"])).alias("_length"),
            *[F.expr(f"aggregate(_es, 0D, (acc, e) -> acc + e.x * e.w{k})").alias(f"_m{k}") for k in classes],
        )
        margins = []
        for k in classes:
            rest = own[k]
            if short:
                weights = F.create_map(*[F.lit(x) for t, r in sorted(short.items()) for x in (t, r[f"w{k}"])])
                rest = F.aggregate(
                    "_others", rest, lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(weights, e["term"]), F.lit(0.0))
                )
            margins.append(F.coalesce(F.lit(self.features.weight) * F.col(f"_m{k}") / F.col("_length"), F.lit(0.0)) + rest)
        scored = stored.join(sums, "_row", "left").select(*df.columns, logistic.shares(margins, self.strategy).alias("_p"))
        return logistic.with_prediction(scored, self.labels, df.columns)

    def _other_names(self) -> list[str]:
        fitted = self.features.lead.stages
        sizes = {s.getOutputCol(): len(s.getScalingVec()) for s in fitted if hasattr(s, "getScalingVec")}
        names = []
        for block in self.features.blocks:
            names += [f"stats:{c}" for c in STATS_COLUMNS] if block == "stats_block" else [f"{block}:{i}" for i in range(sizes.get(block, 0))]
        return names

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """``label, term, weight`` rows."""
        return self.model.coefficients()

    def save(self, path: str) -> None:
        """Below ``path``: the stages up to the tokens, idf, model and one row of settings."""
        spark, f = self.model.weights.sparkSession, self.features
        f.lead.write().overwrite().save(f"{path}/features")
        f.idf.write.mode("overwrite").parquet(f"{path}/idf")
        logistic.save_model(self.model, f"{path}/model", "overwrite")
        rows = [(f.tokens, f.weight, list(f.blocks), self.strategy)]
        schema = "tokens STRING, weight DOUBLE, blocks ARRAY<STRING>, strategy STRING"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> TableTextClassifier:
    row = spark.read.parquet(f"{path}/settings").first()
    idf, lead = spark.read.parquet(f"{path}/idf"), PipelineModel.load(f"{path}/features")
    model = logistic.load_model(spark, f"{path}/model")
    features = TermFeatures(lead, row["tokens"], idf, row["weight"], tuple(row["blocks"]))
    return TableTextClassifier(model.labels, features, model, row["strategy"])


def train(
    rows: DataFrame, labels: Sequence[str], label: str, stages: Sequence, strategy: str, c: float, max_iter: int
) -> TableTextClassifier | None:
    """Fit features and classifier where ``fit_features`` does; None where it does not."""
    found = fit_features(rows, stages, label)
    if found is None:
        return None
    features, stored = found
    values = features.values(stored)
    if features.blocks:
        values = values.unionByName(features.others(stored))
    values = materialise(values, "features")
    docs = stored.select("_row", F.col(label).alias("_label"))
    model = logistic.fit(values, docs, "_row", "_label", "value", c=c, tol=TOLERANCE, max_steps=max_iter, strategy=strategy)
    discard(values)
    discard(stored)
    return TableTextClassifier(tuple(labels), features, model, strategy)
