"""Mix sources to target weights by cube-method balanced sampling.

Every document of a source has the same expected number of copies r = target / size of its
source. ``floor(r)`` copies are certain; the fractional rest is an inclusion probability. The
flight phase moves the probabilities of a few units at a time along the null space of two
constraints, the expected number of documents and of tokens, until one of them is 0 or 1.
Units are dealt to blocks of bounded size, whose few undecided units meet again in the next
round, until one block per source is left. There the last dozen units are the landing problem:
the subset closest to the expected totals is taken.

Defined results: NULL text has size 0. NULL sources form the last source. A source of size 0 has
target 0 and none of its documents is taken. Equal rows (same id, source and size) are units of
one entry that shares its copies out evenly, so no row gets more than two. The draw depends on
the rows and the seed alone, never on their order or partitioning. An empty table gives an empty
result. Further columns are kept; those that clash with a result's name are overwritten.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.llm.common import ship, table, word_count
from tomeweave.sources.workspace import materialise

# Units of one block: bounds the rows of a task's group, not the result.
BLOCK = 1024
# Undecided units of a source that are settled together at the end.
LANDING = 12
# Units whose probabilities move together.
ACTIVE = 12
EPS = 1e-9

_STATE = "_unit BINARY, _source STRING, _size LONG, _p DOUBLE, _taken INT"


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources in code point order, NULL last, get the weights in turn and share ``share`` times all
    sizes. None gets more than ``most`` times its size: sorted by cap per weight, the capped
    sources are a prefix, and the level of the rest is the highest of all prefixes' levels.
    """
    cap = F.col("source_size") * F.lit(float(most))
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn - 1) % len(weights) + 1)
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(rest)
    return (
        sizes.withColumn("_weight", weight)
        .withColumn("_cap", cap)
        .withColumn("_level", level)
        .withColumn("_top", F.max("_level").over(everything))
        .select(
            "source",
            "source_size",
            F.least(F.col("_cap"), F.col("_weight") * F.col("_top")).alias("target"),
        )
    )


def _move(p: np.ndarray, s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One step of the flight over active units, largest first: one reaches 0 or 1 at least.

    The direction is the largest unit's axis, projected onto the null space of the two
    constraints; so large units are settled while smaller ones can still make up for them.
    """
    n = len(p)
    off = s - s.mean()
    spread = off @ off
    off = off / np.sqrt(spread) if spread > EPS else np.zeros(n)
    free = 1 - 1 / n - off * off  # squared length of each axis' projection
    i = int(np.argmax(free > 1e-6))
    u = -1 / n - off[i] * off
    u[i] += 1
    u[np.abs(u) < 1e-12] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - p) / u, np.where(u < 0, p / -u, np.inf)).min()
        down = np.where(u > 0, p / u, np.where(u < 0, (1 - p) / -u, np.inf)).min()
    p = p + (up if rng.random() * (up + down) < down else -down) * u
    p[p < EPS] = 0.0
    p[p > 1 - EPS] = 1.0
    return p


def flight(p: np.ndarray, s: np.ndarray, rng: np.random.Generator, keep: int) -> None:
    """Decide units in place, in the order given, until at most ``max(keep, 2)`` are fractional."""
    p[p < EPS] = 0.0
    p[p > 1 - EPS] = 1.0
    todo = np.flatnonzero((p > 0) & (p < 1))
    active, at = todo[:ACTIVE], min(ACTIVE, len(todo))
    while len(active) + len(todo) - at > max(keep, 2):
        p[active] = _move(p[active], s[active], rng)
        active = active[(p[active] > 0) & (p[active] < 1)]
        more = todo[at : at + ACTIVE - len(active)]
        active, at = np.concatenate([active, more]), at + len(more)


def landing(p: np.ndarray, s: np.ndarray) -> None:
    """Settle the last units: the subset nearest to the expected tokens, then documents."""
    last = np.flatnonzero((p > 0) & (p < 1))
    if not len(last):
        return
    subsets = (np.arange(1 << len(last))[:, None] >> np.arange(len(last))) & 1
    tokens = np.abs(subsets @ s[last] - p[last] @ s[last]) / max(s[last].mean(), 1.0)
    documents = np.abs(subsets.sum(axis=1) - p[last].sum())
    p[last] = subsets[np.argmin(tokens + 0.01 * documents)]


def _decide(seed: int, level: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # The largest are decided first, so that small ones are left to even out the rest.
        group = group.sort_values(["_size", "_unit"], ascending=[False, True], ignore_index=True)
        p, s = group["_p"].to_numpy(float, copy=True), group["_size"].to_numpy(float)
        name = f"{seed}|{level}|{group['_source'].iloc[0]}|{group['_block'].iloc[0]}"
        rng = np.random.default_rng(zlib.crc32(name.encode("utf-8", "surrogatepass")))
        flight(p, s, rng, LANDING if last else 2)
        if last:
            landing(p, s)
        group["_p"] = p
        group["_taken"] = np.where((p > 0) & (p < 1), -1, p).astype(np.int32)
        return group[["_unit", "_source", "_size", "_p", "_taken"]]

    return run


def balanced_sample(units: DataFrame, seed: int = 0) -> DataFrame:
    """``_unit, _taken`` (0 or 1) for ``_unit, _source, _size, _p``: the cube method per source."""
    ship(units.sparkSession)
    pending, decided, level = materialise(units, "cube"), [], 0
    while True:
        counts = pending.groupBy("_source").agg(F.count("*").alias("_n"))
        blocks = F.ceil(F.col("_n") / BLOCK)
        counts = materialise(counts.select("_source", blocks.alias("_blocks")), "cube-blocks")
        largest = counts.agg(F.max("_blocks")).first()[0] or 0
        # Same-source rows sit in equal blocks; the small side is one row per source.
        named = F.col("u._source").eqNullSafe(F.col("c._source"))
        dealt = (
            pending.alias("u")
            .join(counts.alias("c"), named)
            .select("u.*", F.pmod(F.xxhash64("u._unit", F.lit(level)), "_blocks").alias("_block"))
        )
        out = dealt.groupBy("_source", "_block").applyInPandas(_decide(seed, level, largest <= 1), _STATE)
        out = materialise(out, "cube")
        decided.append(out.where("_taken >= 0").select("_unit", "_taken"))
        if largest <= 1:
            break
        pending, level = out.where("_taken < 0").drop("_taken"), level + 1
    result = decided[0]
    for more in decided[1:]:
        result = result.unionByName(more)
    return result


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    size: Column | None = None,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies``, a row per document.

    ``copies`` is how often the mix takes the document: its source's certain copies, and one more
    where the balanced sample holds it.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = materialise(docs.select("doc_id", "source", size.cast("long").alias("size")), "sizes")
    targets = materialise(
        source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most),
        "targets",
    )
    # A row of each entry is one unit; equal rows of an entry differ by number alone.
    same = Window.partitionBy("doc_id", "source", "size").orderBy("doc_id")
    numbered = rows.select(
        "*", F.row_number().over(same).alias("_no"), F.count("*").over(same.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("_of")
    )
    named = F.col("d.source").eqNullSafe(F.col("t.source"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Copies of an entry of n equal rows are n r; row k of them takes every n-th certain copy.
    whole = F.floor(F.col("_of") * F.col("_ratio") + EPS)
    entry = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                              F.col("size").cast("string"), F.coalesce("source", F.lit("\u0000"))))
    planned = materialise(
        numbered.alias("d")
        .join(targets.alias("t"), named)
        .select("d.*", "t.source_size", "t.target", ratio.alias("_ratio"))
        .withColumn("_whole", whole)
        .withColumn("_unit", F.unhex(entry)),
        "planned",
    )
    fraction = F.greatest(F.lit(0.0), F.col("_of") * F.col("_ratio") - F.col("_whole"))
    units = planned.where("_no = 1").select(
        "_unit", F.col("source").alias("_source"), F.col("size").alias("_size"), fraction.alias("_p")
    )
    taken = balanced_sample(units, seed)
    certain = F.floor((F.col("_whole") + F.col("_of") - F.col("_no")) / F.col("_of"))
    one_more = (F.col("_no") == F.col("_whole") % F.col("_of") + 1) & (F.col("_taken") == 1)
    return planned.join(taken, "_unit").select(
        "doc_id", "source", "size", "source_size", "target",
        (certain + one_more.cast("long")).alias("copies"),
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, columns as they were."""
    plan = mix_plan(docs, **how)
    counts = plan.groupBy("doc_id", "source", "size").agg(
        F.sum("copies").alias("_mix_copies"), F.count("*").alias("_mix_of")
    )
    joined = docs.withColumn("_mix_size", word_count(F.col("text"))).alias("d").join(
        counts.alias("p"),
        F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
        & F.col("d.source").eqNullSafe(F.col("p.source"))
        & (F.col("d._mix_size") == F.col("p.size")),
    )
    # Equal rows share their entry's copies out by number, as in the plan.
    order = Window.partitionBy("d.doc_id", "d.source", "d._mix_size").orderBy("d.doc_id")
    copies = F.floor((F.col("_mix_copies") + F.col("_mix_of") - F.col("_mix_no")) / F.col("_mix_of"))
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    numbered = joined.select(*names, "_mix_copies", "_mix_of", F.row_number().over(order).alias("_mix_no"))
    return numbered.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_mix_copy"),
    ).drop("_mix_copy")


def query(spark, folder: str) -> DataFrame:
    """Contract ``op4``: words taken of every document, near its source's target."""
    plan = mix_plan(table(spark, folder, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source"
    )
