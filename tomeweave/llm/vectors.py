"""Packed vectors for the two searches: one binary of doubles per row, read as a numpy matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.llm.common import ship

PACKED = "vec_id LONG, v BINARY, length DOUBLE"
HITS = "query_id LONG, vec_id LONG, score DOUBLE"


def matrix(packed, dims: int) -> np.ndarray:
    """Rows of doubles from binaries."""
    return np.frombuffer(b"".join(packed), np.float64).reshape(-1, dims)


def binaries(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(rows, np.float64)]


def _dense(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with zeros to ``dims``, and which of them are whole and finite."""
    lengths = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()], int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # NULL becomes NaN
    rows, ok = np.zeros((len(lengths), dims)), lengths >= 0
    if ok.all() and (lengths == dims).all():
        rows = flat.reshape(-1, dims)
    else:
        at = 0
        for i, n in enumerate(lengths):
            rows[i, : max(n, 0)] = flat[at : at + max(n, 0)]
            at += max(n, 0)
    return rows, ok & np.isfinite(rows).all(axis=1)


def dimensions(embeddings: DataFrame) -> int:
    """Components of the longest vector, 1 at least."""
    return max(1, embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0)


def pack(embeddings: DataFrame, dims: int, change: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``vec_id, v, length`` of the rows that take part.

    Out are NULL ids, NULL vectors and those with a NULL or non-finite component. Vectors of
    fewer components than the longest are continued with zeros.
    """
    ship(embeddings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ok = _dense(batch.column(1), dims)
            rows, ids = rows[ok], np.array(batch.column(0))[ok]
            rows = rows if change is None else change(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(binaries(rows), pa.binary()),
                 pa.array(np.linalg.norm(rows, axis=1), pa.float64())],
                names=["vec_id", "v", "length"],
            )

    whole = embeddings.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), "embedding")
    return whole.mapInArrow(run, PACKED)


def spread(i: int, n: int) -> int:
    """A block for an id, even where ids share a divisor."""
    return ((i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33) % n


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` smallest scores, ties by id."""
    if len(scores) > k:
        kept = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1])
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], scores[kept]))[:k]]


def ranked(hits: DataFrame, k: int, descending: bool) -> DataFrame:
    """The ``k`` best of each query's hits, numbered from 1. Equal rows count once each."""
    order = F.col("score").desc() if descending else F.col("score")
    by_query = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return hits.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
