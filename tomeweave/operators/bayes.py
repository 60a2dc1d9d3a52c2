"""Multinomial naive Bayes as relational aggregates, with no limit on the vocabulary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.functions.text import let
from tomeweave.sources.workspace import broadcast_if_few, materialise


@dataclass(frozen=True)
class BayesModel:
    """``terms``: a table of one row per training term with its weight per class, ``c0, c1, ...``.

    ``priors`` holds each class's share of the training documents, ``masses`` the smoothed
    total weight of its terms.
    """

    labels: tuple[str, ...]
    priors: tuple[float, ...]
    masses: tuple[float, ...]
    terms: DataFrame
    smoothing: float

    def log_weight(self, i: int) -> Column:
        """Unnormalised log likelihood of a term in class ``i``."""
        return F.log(F.col(f"c{i}") + F.lit(self.smoothing))


def fit(
    counts: DataFrame,
    docs: DataFrame,
    label: str = "label",
    weight: str = "tf",
    smoothing: float = 1.0,
) -> BayesModel:
    """Fit on ``counts(label, term, weight)`` and the training ``docs(label)``.

    The classes are columns, so term weights and scores are plain sums: partial sums are
    built before each shuffle, and no class x vocabulary product is ever laid out as rows.
    The term table is written once; the driver sees one number per class.
    """
    sizes = {r[label]: r["n"] for r in docs.groupBy(label).agg(F.count("*").alias("n")).collect()}
    labels = tuple(sorted(sizes))
    weights = [
        F.sum(F.when(F.col(label) == c, F.col(weight)).otherwise(0)).cast("double").alias(f"c{i}")
        for i, c in enumerate(labels)
    ]
    terms = materialise(counts.groupBy("term").agg(*weights), "term-weights")
    sums = [F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(len(labels))]
    totals = terms.agg(F.count("*").alias("size"), *sums).first()
    masses = tuple(totals[f"c{i}"] + smoothing * totals["size"] for i in range(len(labels)))
    n = sum(sizes.values())
    return BayesModel(labels, tuple(sizes[c] / n for c in labels), masses, terms, smoothing)


def score(
    model: BayesModel,
    counts: DataFrame,
    docs: DataFrame,
    key: str,
    keep: Sequence[str] = (),
    weight: str = "tf",
) -> DataFrame:
    """``key, keep..., scores``: joint log likelihood per class, in label order.

    Terms outside the vocabulary are dropped; a document without known terms keeps the prior.
    """
    classes = range(len(model.labels))
    terms = broadcast_if_few(model.terms)
    known = counts.select(key, "term", F.col(weight).alias("_w")).join(terms, "term")
    sums = known.groupBy(key).agg(
        F.sum("_w").alias("_len"),
        *[F.sum(F.col("_w") * model.log_weight(i)).alias(f"_s{i}") for i in classes],
    )
    length = F.coalesce(F.col("_len"), F.lit(0))
    entries = [
        F.struct(
            F.lit(c).alias("label"),
            (
                F.log(F.lit(model.priors[i]))
                + F.coalesce(F.col(f"_s{i}"), F.lit(0.0))
                - length * F.log(F.lit(model.masses[i]))
            ).alias("score"),
        )
        for i, c in enumerate(model.labels)
    ]
    return docs.select(key, *keep).join(sums, key, "left").select(
        key, *keep, F.array(*entries).alias("scores")
    )


def predict(scored: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep..., prediction``: the best class, the first in label order of equals."""
    values = F.transform("scores", lambda s: s["score"])
    best = F.array_position(values, F.array_max(values)).cast("int")
    return scored.select(*keep, F.element_at("scores", best)["label"].alias("prediction"))


def probabilities(scored: DataFrame, key: str) -> DataFrame:
    """``key, proba``: ``array<struct<label, probability>>`` by softmax inside the row."""

    def softmax(scores: Column) -> Column:
        top = F.array_max(F.transform(scores, lambda s: s["score"]))
        powers = let(
            top,
            lambda m: F.transform(
                scores, lambda s: F.struct(s["label"].alias("label"), F.exp(s["score"] - m).alias("e"))
            ),
        )
        return let(
            powers,
            lambda es: let(
                F.aggregate(es, F.lit(0.0), lambda total, x: total + x["e"]),
                lambda total: F.transform(
                    es,
                    lambda x: F.struct(
                        x["label"].alias("label"), (x["e"] / total).alias("probability")
                    ),
                ),
            ),
        )

    return scored.select(key, let(F.col("scores"), softmax).alias("proba"))


def score_rows(scored: DataFrame, keep: Sequence[str], column: str = "scores") -> DataFrame:
    """``keep..., label, score`` rows (or probabilities). Outer, as no array is empty."""
    return scored.select(*keep, F.inline_outer(column))


def feature_weights(model: BayesModel) -> DataFrame:
    """``label, term, weight``: smoothed log likelihood of each term per class."""
    entries = [
        F.struct(
            F.lit(c).alias("label"),
            (model.log_weight(i) - F.log(F.lit(model.masses[i]))).alias("weight"),
        )
        for i, c in enumerate(model.labels)
    ]
    return model.terms.select("term", F.inline(F.array(*entries)))
