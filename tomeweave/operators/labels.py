"""Weighted tags: consolidation into a small label set, maps and rankings."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.vocab import (
    FOLDED_TAGS,
    HISTORY_TAGS,
    HISTORY_TARGETS,
    MAIN_TAGS,
    OTHER_TAGS,
    OTHER_TARGETS,
)

TYPES = ("fiction", "non-fiction")


class Rule(NamedTuple):
    """A tag's target; ``need`` is the entity type it asks for, '' for any."""

    label: str
    need: str
    target: str


def default_rules() -> list[Rule]:
    """One rule per tag and type: main tags, then folded, history and other tags."""
    groups = [
        [Rule(tag, "", tag) for tag in MAIN_TAGS],
        [Rule(tag, "", main) for tag, main in FOLDED_TAGS.items()],
        [Rule(tag, t, HISTORY_TARGETS[t]) for tag in HISTORY_TAGS for t in TYPES],
        [Rule(tag, t, OTHER_TARGETS[t]) for tag in OTHER_TAGS for t in TYPES],
    ]
    rules: list[Rule] = []
    for group in groups:
        taken = {r.label for r in rules}
        rules += [r for r in group if r.label not in taken]
    return rules


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame(list(rules), "label STRING, need STRING, target STRING")


def consolidate(
    tags: DataFrame,
    entity: str = "entity",
    label: str = "label",
    weight: str = "weight",
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    """``entity, gtype, mapped``: the entity's type and a map target -> greatest weight.

    The default rules, a short fixed list, are broadcast; a caller's are joined as Spark sees fit.
    Everything else is one aggregation per entity over a fixed number of maxima, reduced before
    the shuffle.
    """
    given = rules is not None
    rules = list(rules) if given else default_rules()
    wanted = rule_table(tags.sparkSession, rules)
    wanted = wanted if given else F.broadcast(wanted)
    rows = tags.select(
        F.col(entity), F.col(label).alias("label"), F.col(weight).alias("_weight")
    ).join(wanted, "label", "left")
    needs = {t: sorted({r.need for r in rules if r.target == t}) for t in {r.target for r in rules}}
    targets = sorted(needs)

    def greatest_for(target: str, need: str):
        return F.max(F.when((F.col("target") == target) & (F.col("need") == need), F.col("_weight")))

    maxima = [
        greatest_for(t, need).alias(f"_{i}_{j}")
        for i, t in enumerate(targets)
        for j, need in enumerate(needs[t])
    ]
    flags = [F.bool_or(F.col("label") == t).alias(f"_is_{i}") for i, t in enumerate(TYPES)]
    wide = rows.groupBy(entity).agg(*flags, *maxima)
    gtype = F.when(F.col("_is_0"), TYPES[0]).when(F.col("_is_1"), TYPES[1]).otherwise("")

    def weight_of(i: int, target: str):
        parts = [
            F.col(f"_{i}_{j}") if need == "" else F.when(F.col("gtype") == need, F.col(f"_{i}_{j}"))
            for j, need in enumerate(needs[target])
        ]
        return parts[0] if len(parts) == 1 else F.greatest(*parts)

    entries = F.array(
        *[F.struct(F.lit(t).alias("key"), weight_of(i, t).alias("value")) for i, t in enumerate(targets)]
    )
    return wide.withColumn("gtype", gtype).select(
        entity,
        "gtype",
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("mapped"),
    )


def explode_tags(df: DataFrame, keep: Sequence[str], tags: str = "mapped") -> DataFrame:
    """Map form -> rows ``keep..., label, weight``.

    The outer form with the filter behind it builds each map once; the inner form makes the
    optimizer test the size of the map before, by building it there too.
    """
    rows = df.select(*keep, F.explode_outer(tags).alias("label", "weight"))
    return rows.filter(F.col("label").isNotNull())


def collect_tags(rows: DataFrame, key: Sequence[str], label: str = "label", weight: str = "weight") -> DataFrame:
    """Rows -> map form. Reduced to one row per label first, so a map has no double keys."""
    single = rows.groupBy(*key, label).agg(F.max(weight).alias("_w"))
    return single.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col("_w")))).alias("tags")
    )


def merge_tag_counts(rows: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """``label, n`` over pages: the last page, and the last place on it, wins."""
    return rows.groupBy(label).agg(F.max_by(n, F.struct("page", "pos")).alias(n))


def top_labels(rows: DataFrame, n: int = 100, label: str = "label", count: str = "n") -> DataFrame:
    return rows.orderBy(F.desc(count), F.asc(label)).limit(n)
