"""What several operators share."""

from __future__ import annotations

import ctypes
import io
import os
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.sources.workspace import fresh_path

# The characters that part words in every contract of this package: space, tab to carriage return.
BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words parted by ASCII blanks; 0 for NULL.

    Each word becomes one character, so no array of words is built. The word added at the end
    takes up trailing blanks.
    """
    whole = F.concat(F.coalesce(text, F.lit("")), F.lit(" x"))
    one_each = F.regexp_replace(whole, f"{BLANK}*+{NOT_BLANK}++{BLANK}*+", "x")
    return (F.length(one_each) - 1).cast("long")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver imported it from.

    The archive goes through the shared folder, once per application.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = f"{fresh_path(spark, 'code')}/{os.path.basename(root)}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(archive.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(target)
    _shipped.add(application)


def release() -> None:
    """Give a Python worker's free memory back, at the end of a task: workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task that gives its free memory back when it has read all of its rows."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return whole


def small(df: DataFrame, rows: int) -> DataFrame:
    """A stored table, to be broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")
