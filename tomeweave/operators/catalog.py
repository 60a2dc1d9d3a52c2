"""Catalog maintenance: existence joins, candidate resolution, merging and status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.functions.names import rebase_path, status_of_name, strip_prefix
from tomeweave.operators.groups import keep_first
from tomeweave.sources.workspace import materialise

BOOKS_SCHEMA = (
    "isbn STRING, title STRING, author STRING, gtype STRING, genres_scraped MAP<STRING, BIGINT>, "
    "genres_mapped MAP<STRING, BIGINT>, genres_predicted STRING"
)
LISTING_SCHEMA = (
    "title STRING, author STRING, genre STRING, local_file STRING, dl_url STRING, info_url STRING"
)


def without_existing(entries: DataFrame, existing: DataFrame, key: str = "name") -> DataFrame:
    return entries.join(existing.select(key), key, "left_anti")


def with_existing(entries: DataFrame, existing: DataFrame, key: str = "name") -> DataFrame:
    return entries.join(existing.select(key), key, "left_semi")


def lookup(rows: DataFrame, store: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with what a store holds under their key. The join strategy is left to statistics."""
    return rows.join(store, list(keys), how)


def filter_equals(catalog: DataFrame, column: str, value: str) -> DataFrame:
    return catalog.filter(F.col(column) == F.lit(value))


def filter_in(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return rows.filter(F.col(column).isin(list(values)))


def pending(files: DataFrame, name: str = "file_name") -> DataFrame:
    return files.filter(status_of_name(F.col(name)) == "pending")


def resolve_candidates(
    books: DataFrame,
    catalog: DataFrame,
    tagged: DataFrame,
    key: str = "file_name",
    ids: str = "ids",
    isbn: str = "isbn",
    legacy: bool = False,
) -> DataFrame:
    """``key, isbn, status``: the candidate each book stops at.

    A book stops at its first candidate that the catalog already holds (duplicate) or that has
    tags; without such a candidate it is skipped. Of the books stopping at the same tagged
    candidate the first by key is processed, the others are duplicates. ``legacy`` leaves
    duplicates pending.

    Both lookups are one join with a table unique by candidate; it is stored first, which lets
    the join split the partition of a candidate that a third of all books share. The winners
    are joined back on the book itself.
    """
    known = (
        catalog.select(isbn, F.lit(True).alias("_held"))
        .unionByName(tagged.select(isbn, F.lit(False).alias("_held")))
        .groupBy(isbn)
        .agg(F.bool_or("_held").alias("_held"))
    )
    known = materialise(known, "known")
    candidates = books.select(key, F.posexplode_outer(ids).alias("_pos", isbn))
    stop = F.when(F.col("_held").isNotNull(), F.struct("_pos", isbn, "_held"))
    stops = (
        candidates.join(known, isbn, "left")
        .groupBy(key)
        .agg(F.min(stop).alias("_stop"))
        .select(key, F.col(f"_stop.{isbn}").alias(isbn), F.col("_stop._held").alias("_held"))
    )
    winners = (
        stops.filter(~F.col("_held"))
        .groupBy(isbn)
        .agg(F.min(key).alias(key))
        .select(key, F.lit(True).alias("_won"))
    )
    status = (
        F.when(F.col("_held").isNull(), "skipped")
        .when(F.col("_won"), "processed")
        .otherwise("pending" if legacy else "duplicate")
    )
    return stops.join(winners, key, "left").select(key, isbn, status.alias("status"))


def combine(
    source: DataFrame,
    target: DataFrame,
    genre: str,
    directory: str,
    dedupe: bool = False,
    key: Sequence[str] = ("title", "author"),
) -> DataFrame:
    """The target catalog and the source's rows of one genre, their files moved to ``directory``.

    Plain union by default; ``dedupe`` keeps one row per key, the target's first.
    """
    moved = filter_equals(source, "genre", genre).withColumn(
        "local_file", rebase_path(F.col("local_file"), directory)
    )
    if not dedupe:
        return target.unionByName(moved)
    both = target.withColumn("_origin", F.lit(0)).unionByName(moved.withColumn("_origin", F.lit(1)))
    rest = [F.col(c) for c in target.columns if c not in key]
    return keep_first(both, list(key), [F.col("_origin"), *rest]).drop("_origin")


def upsert(
    old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column] = ()
) -> DataFrame:
    """``old`` with the rows of ``new`` put in place of, or added to, those of the same key.

    Of several new rows of one key the last by ``order`` counts, equal ones by their other
    columns. NULL keys are keys like any other.
    """
    rest = [F.col(c) for c in new.columns if c not in key and _orderable(new, c)]
    single = last_per_key(new, key, [*order, *rest])
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]
    return old.alias("o").join(single.select(*key).alias("n"), same, "left_anti").unionByName(single)


def _orderable(rows: DataFrame, column: str) -> bool:
    return "map<" not in rows.schema[column].dataType.simpleString()


def last_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last writer per key, as when a later file overwrites an earlier one.

    The winner is chosen by key and order alone; the rows, whole texts perhaps, are shuffled once
    and never sorted. Of rows equal in both a hash of the row decides, of equal rows one stays.
    """
    comparable = [F.col(c) for c in rows.columns if _orderable(rows, c)]
    place = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.xxhash64(*comparable).alias("_h"))
    placed = rows.withColumn("_place", place)
    best = placed.groupBy(*key).agg(F.max("_place").alias("_best"))
    placed = placed.alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in key]
    found = placed.join(best.hint("shuffle_hash").alias("w"), same).where(
        F.col("_place").eqNullSafe(F.col("_best"))
    )
    number = F.row_number().over(Window.partitionBy(*[F.col(f"r.{c}") for c in key]).orderBy(F.lit(0)))
    return (
        found.select("r.*", number.alias("_number"))
        .where("_number = 1")
        .select(*rows.columns)
    )


def reset_status(ledger: DataFrame, status: str, column: str = "status") -> DataFrame:
    """Rows of one status become pending again."""
    return ledger.withColumn(
        column, F.when(F.col(column) == status, "pending").otherwise(F.col(column))
    )


def reset_names(files: DataFrame, prefix: str, name: str = "file_name") -> DataFrame:
    return files.withColumn(name, strip_prefix(F.col(name), prefix))


def resume_from(listing: DataFrame, marker: str, name: str = "dir", pos: str = "pos") -> DataFrame:
    """The listing from the first entry equal to the marker on; nothing without such an entry."""
    start = listing.filter(F.col(name) == marker).agg(F.min(pos).alias("start")).scalar()
    return listing.filter(F.col(pos) >= start)
