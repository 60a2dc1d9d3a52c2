"""Documents to packed training sequences, in stages that each write and reread their table.

Toxic documents go; repeated lines go, and with them documents that consist of nothing else; of
each group of near copies one document stays; sources are mixed to their target weights, a
document as often as the mix takes it; what is left is packed into sequences. Every stage works
on all that the one before it kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import line_dedup, mixing, packing, shingle_join, toxicity
from tomeweave.sources.workspace import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, learned from ``labels``, does not grade as toxic."""
    return toxicity.kept(spark, docs, sf_dir)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand elsewhere; documents that were nothing but such lines go."""
    rest = line_dedup.dedup(docs).where("_dropped = 0 OR trim(BOTH FROM text) <> ''").drop("_dropped")
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rest.select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of the shingle join."""
    return shingle_join.kept(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks for."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2,048 tokens."""
    # Executors hold memory of four stages by now: fewer words are remembered, more are encoded again.
    return packing.pack(docs, remembered=24_000_000)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

# Learning, sampling and packing have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
