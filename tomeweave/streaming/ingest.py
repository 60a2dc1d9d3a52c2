"""Process only what has not been seen: new files, and new keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tomeweave.functions.clean import charset_of, decode_bytes
from tomeweave.functions.names import file_name_of, parent_name_of
from tomeweave.operators.groups import keep_first
from tomeweave.sources.file_stream import stream_every_file
from tomeweave.sources.workspace import path_exists


def stream_raw_files(spark: SparkSession, root: str, log: str) -> DataFrame:
    """``path, label, file_name, charset, text`` of each file, as files arrive, whatever their names.

    ``log`` is a folder of the stream's own, where it keeps what it has listed.
    """
    path, content = F.col("path"), F.col("content")
    return stream_every_file(spark, root, log).select(
        path,
        parent_name_of(path).alias("label"),
        file_name_of(path).alias("file_name"),
        charset_of(content).alias("charset"),
        decode_bytes(content).alias("text"),
    )


def stream_table(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None
) -> DataFrame:
    """Rows of a Parquet table's files as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def ingest_new(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append whatever the checkpoint has not recorded yet, then stop."""
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )


def ingest_first_per_key(
    rows: DataFrame, target: str, checkpoint: str, key: Sequence[str], order: Sequence[Column]
) -> StreamingQuery:
    """Append rows whose key the target does not hold yet.

    Among the rows of one batch the first by ``order`` wins, between batches the earlier batch. A
    stream without a cap on files is one batch per run, so the first of all that waits wins.

    Each batch owns one partition directory and overwrites only that, and compares itself with
    earlier batches only, so a batch that is run again after a failure leaves the same table.
    """
    return (
        rows.writeStream.foreachBatch(_first_writer(target, list(key), list(order)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _first_writer(
    target: str, key: list[str], order: list[Column]
) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = keep_first(batch, key, order)
        if path_exists(spark, target):
            schema = fresh.schema.add("batch", "integer")
            held = spark.read.schema(schema).option("basePath", target).parquet(target)
            same = [F.col(f"f.{c}").eqNullSafe(F.col(f"h.{c}")) for c in key]
            earlier = held.filter(F.col("batch") < batch_id).select(*key)
            fresh = fresh.alias("f").join(earlier.alias("h"), same, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write
