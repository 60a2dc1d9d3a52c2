"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

An anchor's positives are its best rows of the same label; each positive opens a window of scores,
a share of its own, from which the best rows of other labels are taken. Both are threshold joins
in the manner of L2AP. Rows are dealt to blocks; within a block the dimensions, strongest first,
hold postings of the rows. A row is left out of the lists from the dimension on from which its
remaining norm times the anchors' cannot reach the lowest threshold asked, and out of all lists if
it cannot be reached at all. An anchor walks the lists, accumulates partial products and drops
rows whose partial product and remaining norms stay below its threshold; the rest are multiplied
out whole.

Thresholds start high and are lowered until the windows are filled. A slice of the blocks is
joined first. Its ``AHEAD``-th score is the first threshold for the other blocks; windows that it
leaves unfilled are joined again down to the slice's ``k``-th score, which is sure to fill them, or
to the window's own floor where the slice holds fewer.

Defined results: rows with a NULL id or label, a NULL vector or a NULL or non-finite component take
no part. Short vectors are continued with zeros. Equal scores are ranked by id. Rows of an anchor's
own id are neither its positives nor its negatives. Repeated rows are rows each: a repeated anchor
is answered each time, a repeated candidate may take several ranks. A positive without a row in
its window has none. Products beyond a long are cut to its range. Other columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.llm.common import ship, table
from tomeweave.llm.exact_search import products
from tomeweave.llm.vectors import _dense, best, dimensions
from tomeweave.sources.workspace import materialise

# Dimensions of a step of the lists, rows and anchors of a block.
STEP, ROWS, ANCHORS = 8, 4096, 4096
# One in so many blocks is the slice; the rank in it that sets the first threshold.
SLICE, AHEAD = 16, 2
SLACK = 1e-9
# No threshold, and no upper end.
NONE, ALL = -(2**63), 2**63 - 1

ROW = "row LONG, vec_id LONG, label LONG, v BINARY, asks BOOLEAN"
HIT = "row LONG, window INT, vec_id LONG, score LONG"


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Integers that are stored as doubles, in the narrowest type that holds them."""
    most = np.abs(rows).max(initial=0)
    return rows.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def _matrix(packed: list[bytes], dims: int) -> np.ndarray:
    """Doubles from rows that may be stored in different types."""
    out = np.empty((len(packed), dims))
    kinds = {2 * dims: np.int16, 4 * dims: np.int32, 8 * dims: np.float64}
    sizes = np.array([len(p) for p in packed], int)
    for size in np.unique(sizes):
        held = np.flatnonzero(sizes == size)
        out[held] = np.frombuffer(b"".join(packed[i] for i in held), kinds[int(size)]).reshape(-1, dims)
    return out


def _tails(rows: np.ndarray) -> np.ndarray:
    """Norms of what is left of each row before every step, and 0 after the last."""
    steps = -(-rows.shape[1] // STEP)
    squares = np.zeros((len(rows), steps + 1))
    for s in range(steps):
        squares[:, s] = (rows[:, s * STEP : (s + 1) * STEP] ** 2).sum(axis=1)
    return np.sqrt(squares[:, ::-1].cumsum(axis=1)[:, ::-1])


class Index:
    """Postings of a block's rows, step by step of the dimensions.

    ``reach`` holds the anchors' largest remaining norms and ``least`` their lowest threshold.
    Rows are in order of how far they are indexed, so the lists of a step hold the first
    ``listed[step]`` rows.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, reach: np.ndarray, least: float):
        tails = _tails(rows)
        steps = tails.shape[1] - 1
        if least > 0:
            depth = np.argmax(tails * reach * (1 + SLACK) < least, axis=1)
        else:
            depth = np.full(len(rows), steps)
        order = np.argsort(-depth, kind="stable")
        self.ids, self.labels, self.rows, self.tails = ids[order], labels[order], rows[order], tails[order]
        self.listed = [int((depth > s).sum()) for s in range(steps)]
        self.longest = float(tails[:, 0].max(initial=0.0))

    def candidates(self, q: np.ndarray, tails: np.ndarray, least: float) -> np.ndarray:
        """Positions of the rows that may reach ``least``; all that do are among them."""
        least = least - SLACK * tails[0] * self.longest
        alive = np.arange(self.listed[0])
        partial, found = np.zeros(len(alive)), []
        for s, listed in enumerate(self.listed):
            n = int(np.searchsorted(alive, listed))
            if n < len(alive):  # in no further list
                found.append(alive[n:])
                alive, partial = alive[:n], partial[:n]
            if not n:
                break
            part = slice(s * STEP, (s + 1) * STEP)
            postings = self.rows[:listed, part] if n == listed else self.rows[alive, part]
            partial = partial + postings @ q[part]
            kept = partial + self.tails[alive, s + 1] * tails[s + 1] >= least
            alive, partial = alive[kept], partial[kept]
        return np.concatenate([*found, alive])

    def scores(self, q: np.ndarray, tails: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and whole products of the rows that reach ``least``."""
        at = self.candidates(q, tails, float(least))
        scores = products(self.rows[at], q, self.longest, float(tails[0]))
        return at[scores >= least], scores[scores >= least]


@dataclass(frozen=True)
class Blocks:
    """Stored rows dealt to blocks, the first ``slice`` of which are joined first."""

    rows: DataFrame
    dims: int
    blocks: int
    slice: int
    parts: int  # of the anchors

    def search(self, windows: DataFrame, first: bool, k: int, same: bool) -> DataFrame:
        """The ``k`` best rows of every window in each block of the slice, or of the others.

        ``windows`` holds ``row, window, least, high``; rows of the anchor's own label count
        (``same``) or those of other labels.
        """
        low, high = (0, self.slice) if first else (self.slice, self.blocks)
        asked = windows.groupBy("row").agg(
            F.min("least").alias("least"), F.collect_list(F.struct("window", "least", "high")).alias("windows")
        )
        # Columns of their own: the two sides of the search come from the same table.
        anchors = self.rows.where("asks").select("row", *[F.col(c).alias(f"own_{c}") for c in ("vec_id", "label", "v")])
        asked = asked.join(anchors, "row").select(
            "*",
            F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("at_block"),
            F.pmod(F.xxhash64("row"), F.lit(self.parts)).cast("int").alias("at_part"),
        )
        held = self.rows.where(F.col("block").between(low, high - 1)).select(
            "vec_id", "label", "v", "block",
            F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part"),
        )
        return held.groupBy("block", "part").cogroup(asked.groupBy("at_block", "at_part")).applyInArrow(
            _joined(self.dims, k, same), HIT
        )


def _joined(dims: int, k: int, same: bool):
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
        if held.num_rows and asked.num_rows:
            anchors = _matrix(asked.column("own_v").to_pylist(), dims)
            tails = _tails(anchors)
            floors = asked.column("least").to_numpy()
            index = Index(
                held.column("vec_id").to_numpy(), held.column("label").to_numpy(),
                _matrix(held.column("v").to_pylist(), dims), tails.max(axis=0), float(floors.min()),
            )
            columns = (asked.column(c).to_pylist() for c in ("row", "own_vec_id", "own_label", "windows"))
            for i, (row, own, label, windows) in enumerate(zip(*columns)):
                at, scores = index.scores(anchors[i], tails[i], int(floors[i]))
                kept = ((index.labels[at] == label) == same) & (index.ids[at] != own)
                ids, scores = index.ids[at[kept]], scores[kept]
                for w in windows:
                    inside = np.flatnonzero((scores >= w["least"]) & (scores <= w["high"]))
                    first = inside[best(-scores[inside], ids[inside], k)]
                    n = len(first)
                    out.append((np.full(n, row), np.full(n, w["window"]), ids[first], scores[first]))
        row, window, ids, scores = (np.concatenate(c) for c in zip(*out))
        return pa.table({"row": row, "window": pa.array(window, pa.int32()), "vec_id": ids, "score": scores})

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    by_window = Window.partitionBy("row", "window").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by_window)).where(F.col("rank") <= k)


def _fill(blocks: Blocks, windows: DataFrame, k: int, same: bool, name: str) -> DataFrame:
    """``row, window, vec_id, score, rank``: the ``k`` best rows of each of the stored ``windows``.

    A window holds ``row, window, low, high``.
    """
    key = ["row", "window"]
    some = blocks.search(windows.withColumn("least", F.col("low")), True, k, same)
    some = materialise(_ranked(some, k), f"{name}-slice")
    if blocks.slice == blocks.blocks:
        return some

    def mark(rank: int) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("score")))

    marks = some.groupBy(*key).agg(mark(min(AHEAD, k)).alias("ahead"), mark(k).alias("sure"))
    windows = materialise(
        windows.join(marks, key, "left").select(
            *key, "low", "high",
            F.coalesce("ahead", "low").alias("least"), F.coalesce("sure", "low").alias("sure"),
        ),
        f"{name}-thresholds",
    )
    more = materialise(_ranked(some.drop("rank").unionByName(blocks.search(windows, False, k, same)), k), f"{name}-first")
    reached = more.join(windows, key).where("score >= least").groupBy(*key).agg(F.count("*").alias("n"))
    unfilled = materialise(
        windows.join(reached, key, "left").where((F.coalesce("n", F.lit(0)) < k) & (F.col("least") > F.col("sure")))
        .select(*key, "low", "high", F.col("sure").alias("least")),
        f"{name}-unfilled",
    )
    if unfilled.isEmpty():
        return more
    again = some.drop("rank").join(unfilled.select(*key), key, "left_semi").unionByName(
        blocks.search(unfilled, False, k, same)
    )
    filled = more.join(unfilled.select(*key), key, "left_anti")
    return materialise(filled.unionByName(_ranked(again, k)), f"{name}-filled")


def _rows(embeddings: DataFrame, label: Column, anchors: Column, dims: int, scale: float) -> DataFrame:
    """``ROW`` of the rows that take part, with a number of their own and integer components."""
    ship(embeddings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ok = _dense(batch.column("embedding"), dims)
            kept = batch.filter(pa.array(ok))
            v = [r.tobytes() for r in _smallest(np.floor(scale * rows[ok]))]
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(c) for c in ("row", "vec_id", "label")), pa.array(v, pa.binary()), kept.column("asks")],
                names=["row", "vec_id", "label", "v", "asks"],
            )

    whole = embeddings.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"), "embedding",
    )
    return whole.where("vec_id IS NOT NULL AND label IS NOT NULL").mapInArrow(run, ROW)


def _strongest_first(rows: DataFrame, dims: int) -> list[int]:
    """Dimensions by falling sum of squares over all rows, ties in their own order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims)
        for batch in batches:
            total += (_matrix(batch.column(0).to_pylist(), dims) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total)], names=["at", "squares"])

    sums = rows.select("v").mapInArrow(run, "at LONG, squares DOUBLE").groupBy("at").agg(F.sum("squares").alias("s"))
    return [r["at"] for r in sums.orderBy(F.desc("s"), "at").collect()] or list(range(dims))


def _in_order(rows: DataFrame, order: list[int]) -> DataFrame:
    """The rows with their dimensions in the given order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("v")
            held = _smallest(_matrix(batch.column(at).to_pylist(), len(order))[:, order])
            yield batch.set_column(at, "v", pa.array([r.tobytes() for r in held], pa.binary()))

    return rows.mapInArrow(run, rows.schema)


def hard_negatives(
    embeddings: DataFrame,
    anchors: Column,
    label: Column,
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Every row that ``anchors`` holds for has as positives its ``positives`` best other rows of the
    same label; each of them has the ``negatives`` best rows of other labels whose score lies
    between ``least`` and ``most`` hundredths of the positive's. Components count as
    ``floor(scale * x)``, a score is the integer inner product.
    """
    dims = dimensions(embeddings)
    rows = materialise(_rows(embeddings, label, anchors, dims, scale), "vectors")
    n = rows.agg(F.count("*").alias("rows"), F.count(F.when(F.col("asks"), 1)).alias("anchors")).first()
    count = max(1, -(-n["rows"] // ROWS))
    dealt = _in_order(rows, _strongest_first(rows, dims)).withColumn(
        "block", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    )
    blocks = Blocks(materialise(dealt, "blocks"), dims, count, -(-count // SLICE), max(1, -(-n["anchors"] // ANCHORS)))
    asking = blocks.rows.where("asks").select("row", F.col("vec_id").alias("anchor_id"))
    whole = asking.select("row", F.lit(0).alias("window"), F.lit(NONE).alias("low"), F.lit(ALL).alias("high"))
    found = _fill(blocks, whole, positives, True, "positives").select(
        "row", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    found = materialise(found, "positives")
    hundredths = F.col("positive_score").cast("decimal(20,0)")
    windows = found.select(
        "row", "window",
        F.ceil(hundredths * least / 100).cast("long").alias("low"),
        F.floor(hundredths * most / 100).cast("long").alias("high"),
    )
    windows = materialise(windows.where("low <= high"), "windows")
    chosen = _fill(blocks, windows, negatives, False, "negatives").select(
        "row", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return chosen.join(found, ["row", "window"]).join(asking, "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def query(spark, folder: str) -> DataFrame:
    """Contract ``op11``: ten negatives for each of five positives of every hundredth vector."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, moved)


SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), placed AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM placed WHERE rank <= 10
"""
