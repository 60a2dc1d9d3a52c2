"""Exact top-k inner product search by norm-bucketed retrieval.

Vectors are grouped by length into classes of equal ratio; a class of many rows is dealt to
buckets of bounded size. A query's k-th best product with the longest vectors is a lower bound
``t`` of what it looks for. A bucket whose longest vector cannot reach ``t`` never sees the query.
Elsewhere the local cosine threshold ``t / (|q| l)`` decides: where it is high, each of the
query's strongest coordinates leaves only an interval for the candidates, read off the bucket's
sorted coordinate lists (coordinate pruning); where that leaves more than half of the bucket,
the prefix of long enough vectors is taken (length pruning). What survives is multiplied out.

Queries and buckets meet in blocks, so neither a hot vector nor many queries fill one group.

Defined results: rows with NULL ids, NULL vectors or NULL or non-finite components take no part.
Short vectors are continued with zeros; zero vectors score 0. Equal vectors are ranked by id.
A query never meets rows of its own id. Repeated rows are rows each: a repeated candidate may take
several ranks, repeated queries share one ranking. Products beyond a long are cut to its range.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.common import table
from tomeweave.llm.vectors import best, dimensions, matrix, pack, ranked, spread
from tomeweave.sources.workspace import materialise

# Ratio of lengths within a class, rows of a bucket, queries of a block, longest rows for bounds.
RATIO, BUCKET, QUERIES, LONGEST = 1.02, 4096, 1024, 2048
FOCUS = 3
SLACK = 1e-9
# Sums of products below this are exact in doubles.
EXACT = 2.0**52


def quantised(rows: np.ndarray) -> np.ndarray:
    return np.floor(rows * 1024.0)


def products(rows: np.ndarray, q: np.ndarray, longest: float, length: float) -> np.ndarray:
    """Integer inner products, as longs."""
    if longest * length < EXACT:
        return (rows @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(r, q)) for r in rows]
    return np.array([min(max(x, 1 - 2**63), 2**63 - 1) for x in exact], np.int64)


class Bucket:
    """Rows by falling length, with their directions and sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, -lengths))
        self.ids, self.rows, self.lengths = ids[order], rows[order], lengths[order]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.directions = np.nan_to_num(self.rows / self.lengths[:, None], posinf=0, neginf=0)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.directions[:, f], kind="stable")
            self.lists[f] = order, self.directions[order, f]
        return self.lists[f]

    def candidates(self, q: np.ndarray, length: float, bound: float) -> np.ndarray | slice:
        """Rows that may reach ``bound``; all that do are among them."""
        if not bound > 0 or not length > 0:
            return slice(None)
        if length * self.lengths[0] * (1 + SLACK) < bound:
            return slice(0, 0)
        cosine = min(1.0, bound / (length * self.lengths[0]))
        # An angle of at most ``wide`` to the query bounds the angle to each axis.
        wide = math.acos(cosine) + 1e-7
        direction = q / length
        focus = np.argsort(-np.abs(direction))[:FOCUS]
        angles = np.arccos(np.clip(direction[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, angles + wide)) - SLACK
        high = np.cos(np.maximum(0.0, angles - wide)) + SLACK
        ranges = []
        for f, a, b in zip(focus, low, high):
            order, values = self._list(int(f))
            ranges.append((np.searchsorted(values, a, "left"), np.searchsorted(values, b, "right"), order))
        a, b, order = min(ranges, key=lambda r: r[1] - r[0])
        if b - a > len(self.ids) // 2:
            return slice(0, int(np.searchsorted(-self.lengths, -bound / length * (1 - SLACK), "right")))
        kept = order[a:b]
        inside = self.directions[kept][:, focus]
        return kept[((inside >= low) & (inside <= high)).all(axis=1)]

    def top(self, query_id: int, q: np.ndarray, length: float, bound: float, k: int):
        """Ids and products of the bucket's best ``k`` that reach ``bound``."""
        where = self.candidates(q, length, bound)
        rows, ids = self.rows[where], self.ids[where]
        scores = products(rows, q, float(self.lengths[0]), length)
        kept = (ids != query_id) & (scores >= bound)
        scores, ids = scores[kept], ids[kept]
        first = best(-scores, ids, k)
        return ids[first], scores[first]


def top_products(embeddings: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that ``queries`` holds for, against all others."""
    spark, dims = embeddings.sparkSession, dimensions(embeddings)
    step = math.log(RATIO)
    rows = materialise(
        pack(embeddings, dims, quantised)
        # Zero vectors form the lowest class.
        .withColumn("class", F.when(F.col("length") > 0, F.floor(F.log("length") / step)).otherwise(-(10**9)))
        .withColumn("asks", F.coalesce(queries, F.lit(False))),
        "products",
    )
    classes = rows.groupBy("class").agg(F.count("*").alias("n"), F.max("length").alias("top")).collect()
    asking = rows.where("asks").count()
    # Bounded by the grid of lengths that doubles can have, not by the rows.
    chunks = {r["class"]: -(-r["n"] // BUCKET) for r in classes}
    tops = {r["class"]: r["top"] for r in classes}
    blocks = max(1, -(-asking // QUERIES))
    seed = rows.orderBy(F.col("length").desc(), "vec_id").limit(LONGEST).select("vec_id", "v", "length").toPandas()
    seeds = matrix(seed["v"], dims) if len(seed) else np.zeros((0, dims))
    seed_ids = seed["vec_id"].to_numpy(np.int64)
    longest = float(seed["length"].max()) if len(seed) else 0.0

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its bound, once for every bucket that can reach it."""
        for batch in batches:
            out: list[tuple] = []
            ids, packed, lengths = (batch.column(i).to_pylist() for i in range(3))
            for i, v, length in zip(ids, packed, lengths):
                found = np.sort(products(seeds, np.frombuffer(v), longest, length)[seed_ids != i])
                bound = float(found[-k]) if len(found) >= k else -math.inf
                bound = np.nextafter(bound, -math.inf) if abs(bound) > 2**53 else bound
                block = spread(i, blocks)
                for c, n in chunks.items():
                    if not bound > 0 or length * tops[c] * (1 + SLACK) >= bound:
                        out.extend((i, v, length, bound, c, j, block) for j in range(n))
            columns = list(zip(*out)) or [[]] * 7
            types = [pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["query_id", "v", "length", "bound", "class", "chunk", "block"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    asked = rows.where("asks").select("vec_id", "v", "length").mapInArrow(
        route,
        "query_id LONG, v BINARY, length DOUBLE, bound DOUBLE, class LONG, chunk LONG, block LONG",
    )
    sizes = F.create_map(*[F.lit(x) for pair in (chunks or {0: 1}).items() for x in pair])
    stored = rows.select(
        "vec_id", "v", "length", "class",
        F.pmod(F.xxhash64("vec_id", "v"), F.element_at(sizes, F.col("class"))).alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"),
    )

    def search(held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asks):
            bucket = Bucket(held["vec_id"].to_numpy(), matrix(held["v"], dims), held["length"].to_numpy())
            for i, v, length, bound in zip(asks["query_id"], asks["v"], asks["length"], asks["bound"]):
                ids, scores = bucket.top(i, np.frombuffer(v), length, bound, k)
                out.append(pd.DataFrame({"query_id": i, "vec_id": ids, "score": scores}))
        empty = pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("query_id", "vec_id", "score")})
        return pd.concat([empty, *out], ignore_index=True)

    key = ["class", "chunk", "block"]
    hits = (
        stored.groupBy(*key).cogroup(asked.groupBy(*key))
        .applyInPandas(search, "query_id LONG, vec_id LONG, score LONG")
    )
    return ranked(hits, k, descending=True).select("query_id", "rank", "vec_id", "score")


def query(spark, folder: str) -> DataFrame:
    """Contract ``op1``: the ten highest products of every hundredth vector."""
    return top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10
"""
