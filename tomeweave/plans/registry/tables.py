"""Access to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tomeweave.sources.workspace import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The texts, over all cores even where the file has a single row group."""
    return spread(table(spark, folder, "documents").select("doc_id", *columns), "doc_id")


def rows(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A narrow table that costly expressions run over, likewise over all cores."""
    return spread(table(spark, folder, name), key)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages"), "page_id")


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
