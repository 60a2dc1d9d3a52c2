"""First, best and worst rows of a group, safe for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.functions.names import is_system_file
from tomeweave.sources.workspace import materialise

_SALTS = 64


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the smallest by ``order``.

    An aggregate rather than a window: each task reduces its share of a group to one row
    before the shuffle, so a group holding a third of the table costs no more than a small one.
    """
    rank = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*rank)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def first_per_group(
    files: DataFrame,
    group: str = "dir",
    name: str = "file_name",
    markers: tuple[str, ...] = (".DS", "readme"),
    filter_first: bool = False,
) -> DataFrame:
    """The first file stands for its directory.

    System files are dropped after the choice, so a directory that starts with one is lost;
    ``filter_first`` drops them before.
    """
    usable = ~is_system_file(F.col(name), markers)
    if filter_first:
        return keep_first(files.filter(usable), [group], [F.col(name)])
    return keep_first(files, [group], [F.col(name)]).filter(usable)


def top_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows per group in ``order``, numbered from 1.

    A salted round first cuts each group to ``n`` rows per salt, so a group that holds a third of
    the table is ranked in many tasks.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(_SALTS))
    salted = Window.partitionBy(*group, "_salt").orderBy(*order)
    df = (
        df.withColumn("_salt", salt)
        .withColumn("_rn", F.row_number().over(salted))
        .filter(F.col("_rn") <= n)
        .drop("_salt", "_rn")
    )
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("bigint"))


def first_n(df: DataFrame, order: Sequence[Column], n: int, parts: int | None = None) -> DataFrame:
    """The first ``n`` rows of the whole table in ``order``, without a task that sees them all.

    Rows are dealt out by ranges of ``order`` and sorted there, so a row's place is the rows of the
    ranges before it, one number per range, and its place within its own. ``order`` should be
    total. The result is a stored table.
    """
    ranges = df.repartitionByRange(*order) if parts is None else df.repartitionByRange(parts, *order)
    # The number holds the range above bit 33 and the place in it below.
    placed = materialise(ranges.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    held = placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect()
    before, starts = 0, []
    for r in sorted(held, key=lambda r: r["part"]):
        starts.append((r["part"], before))
        before += r["n"]
        if before >= n:
            break
    if not starts:
        return placed.drop("_at")
    last, skipped = starts[-1]
    # Ranges before the last are kept whole, of the last one what is missing.
    place = F.col("_at") - F.lit(last).cast("bigint") * F.lit(1 << 33)
    return placed.where(place < n - skipped).drop("_at")


def top_features(df: DataFrame, label: str, feature: str, weight: str, n: int = 25) -> DataFrame:
    """The ``n`` features of greatest weight per label."""
    return top_n_per_group(df, [label], [F.desc(weight), F.asc(feature)], n)


def bottom_features(df: DataFrame, label: str, feature: str, weight: str, n: int = 25) -> DataFrame:
    """The ``n`` features of least weight per label."""
    return top_n_per_group(df, [label], [F.asc(weight), F.asc(feature)], n)
