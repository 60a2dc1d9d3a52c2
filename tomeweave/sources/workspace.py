"""The folder for tables and checkpoints that several stages of a job share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names; a temporary one only in local mode, where none is named."""
    named = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_CONF} must name a folder that every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tomeweave-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's own subfolder, which may be deleted after it."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{application}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or directory; errors in looking are errors."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several plans reuse and read it back.

    Unlike cached blocks it outlives the executors that computed it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """The same in ``parts`` buckets by ``key``, which joins and sums by it leave where they are.

    Buckets are known to a table only. Its name is dropped once it is read; the files stay.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = "tomeweave_" + path.rpartition("/")[2].replace("-", "_")
    df.repartition(parts, key).write.bucketBy(parts, key).saveAsTable(table, format="parquet", path=path)
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return stored


def discard(stored: DataFrame) -> None:
    """Delete a table that ``materialise`` or ``materialise_by`` wrote, once its last reader is done."""
    spark = stored.sparkSession
    ours = f"/{spark.sparkContext.applicationId}/"
    folders = {f.rpartition("/")[0] for f in stored.inputFiles() if ours in f}
    for folder in folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


# Rows up to which a stored table of terms or keys is broadcast, some tens of MB in memory.
FEW = 500_000


def broadcast_if_few(stored: DataFrame) -> DataFrame:
    """A stored table as the small side of a join: broadcast if it has no more than ``FEW`` rows.

    Beyond that the join is by merging, which lets a skewed partition be split. Either way the
    other side, whose size Spark cannot estimate where it comes from an exploded array, is never
    the one that is built into a hash table.
    """
    few = stored.limit(FEW + 1).count() <= FEW
    return F.broadcast(stored) if few else stored.hint("merge")


SPREAD = "spark.tomeweave.inputPartitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a scan out by a key, if the session asks for it: ``spark.tomeweave.inputPartitions``.

    For small inputs in files of one split, as in tests and on one machine. Without the setting a
    scan is left as it is.
    """
    wanted = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(wanted), *keys) if wanted else df
