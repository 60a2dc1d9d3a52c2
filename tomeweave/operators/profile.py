"""Corpus profile: averages, line counts and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.functions.text import char_count, let, line_count, sentences


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_lines`` and ``n_chars`` per text."""
    body = F.col(text)
    return df.withColumns({"n_lines": line_count(body), "n_chars": char_count(body)})


def profile(df: DataFrame, by: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Number of texts and average lines and characters, overall or per group.

    Averages of an empty corpus are NULL.
    """
    measured = df.select(
        *by, line_count(F.col(text)).alias("n_lines"), char_count(F.col(text)).alias("n_chars")
    )
    return measured.groupBy(*by).agg(
        F.count("*").alias("n_docs"),
        F.avg("n_lines").alias("avg_lines"),
        F.avg("n_chars").alias("avg_chars"),
    )


def histogram_bin(value: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin 1..bins of equal width; the last one includes ``hi``; NULL outside."""
    return (
        F.when(value == hi, F.lit(bins).cast("bigint"))
        .when((value < lo) | (value > hi), F.lit(None).cast("bigint"))
        .otherwise(F.width_bucket(value, F.lit(lo), F.lit(hi), F.lit(bins)))
    )


def histogram(
    df: DataFrame, value: str, bins: int = 10, lo: float = 0.0, hi: float = 30000.0
) -> DataFrame:
    """Count per bin, empty bins included: ``bin, lo, hi, n``."""
    # Values out of range go to bin 0, which the grid lacks. A nullable bin would be tested for
    # NULL ahead of the measure it comes from, which then is computed twice.
    placed = F.coalesce(histogram_bin(F.col(value), float(lo), float(hi), bins), F.lit(0))
    counts = (
        df.select(placed.cast("bigint").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    width = (hi - lo) / bins
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.lit(float(lo)) + (F.col("bin") - 1) * F.lit(float(width))).alias("lo"),
        (F.lit(float(lo)) + F.col("bin") * F.lit(float(width))).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def document_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``length``, ``num_sentences`` and ``avg_sentence_length`` in characters."""

    def stats(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0).cast("bigint"), lambda a, s: a + F.length(s))
        n = F.size(found).cast("bigint")
        return F.struct(
            n.alias("num_sentences"),
            F.try_divide(total.cast("double"), n.cast("double")).alias("avg_sentence_length"),
        )

    return df.withColumn("_stats", let(sentences(F.col(text)), stats)).select(
        *df.columns, F.length(text).cast("bigint").alias("length"), "_stats.*"
    )
