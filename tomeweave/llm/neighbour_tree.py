"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is indexed, under the leaf it descends to. A
query descends to its nearest leaf and keeps the branches it passed in a priority queue, from
which the next nearest bin is taken up until it has visited the calibrated number of leaves.
That number is found by widening: for a bounded set of queries, whose true neighbours among all
rows are computed, it is raised until ``recall`` of them lie in visited leaves. Leaves that hold
many rows, or that many queries visit, are dealt to blocks, so a hot vector fills no group.

Defined results: rows with NULL ids, NULL or zero vectors or NULL or non-finite components take no
part. Short vectors are continued with zeros. Equal distances are ranked by id. A query never
meets rows of its own id. Repeated rows are rows each: a repeated candidate may take several
ranks, repeated queries share one ranking. Other columns are not read. An empty table gives no
rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.common import table
from tomeweave.llm.vectors import HITS, best, dimensions, matrix, pack, ranked
from tomeweave.sources.workspace import materialise

# Rows the tree is fitted on and queries it is calibrated on, at most about; neither grows.
SAMPLE, CALIBRATION = 20_000, 200
# Children of a node, rows a leaf should hold, Lloyd steps of a node.
BRANCH, LEAF, STEPS = 8, 256, 8
# Rows and queries of a block, leaves visited before the others get a bound.
BLOCK, QUERIES, FIRST = 4096, 1024, 8


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - q) ** 2).sum(axis=1))


def _cluster(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Centres of k-means; fewer than BRANCH where rows coincide."""
    centres = np.unique(rows[rng.choice(len(rows), BRANCH, replace=False)], axis=0)
    for _ in range(STEPS):
        owner = _nearest(rows, centres)
        centres = np.array([rows[owner == i].mean(axis=0) for i in range(len(centres)) if (owner == i).any()])
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)


class Tree:
    """Nodes as arrays of child centres; ``child`` numbers nodes from 0 and leaves from -1 down."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 0):
        self.centres: list[np.ndarray] = []
        self.child: list[np.ndarray] = []
        self.leaves = 0
        self._scale = rows / max(1, len(sample))
        self.root = self._grow(sample, np.random.default_rng(seed))

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        if len(rows) < 2 * BRANCH or len(rows) * self._scale <= LEAF:
            return self._leaf()
        centres = _cluster(rows, rng)
        if len(centres) < 2:
            return self._leaf()
        node = len(self.centres)
        self.centres.append(centres)
        self.child.append(np.zeros(len(centres), int))
        owner = _nearest(rows, centres)
        for i in range(len(centres)):
            self.child[node][i] = self._grow(rows[owner == i], rng)
        return node

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf, from 0, that each row descends to."""
        leaf = np.zeros(len(rows), np.int64)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, held = todo.pop()
            if node < 0:
                leaf[held] = -1 - node
            elif len(held):
                owner = _nearest(rows[held], self.centres[node])
                todo += [(int(c), held[owner == i]) for i, c in enumerate(self.child[node])]
        return leaf

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        bins = [(0.0, 0, self.root)]
        serial = 0
        while bins:
            _, _, node = heapq.heappop(bins)
            while node >= 0:
                away = ((self.centres[node] - q) ** 2).sum(axis=1)
                nearest = int(np.argmin(away))
                for i, c in enumerate(self.child[node]):
                    if i != nearest:
                        serial += 1
                        heapq.heappush(bins, (float(away[i]), serial, int(c)))
                node = int(self.child[node][nearest])
            yield -1 - node


def fit(packed: DataFrame, dims: int, rows: int) -> Tree:
    """A tree over about SAMPLE rows, chosen by a hash of their ids."""
    share = min(1 << 20, int((1 << 20) * SAMPLE / max(rows, 1)))
    sample = packed.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).select("vec_id", "v").toPandas()
    sample = sample.sort_values(["vec_id", "v"])
    return Tree(matrix(sample["v"], dims), rows)


def _true_neighbours(indexed: DataFrame, asked: pd.DataFrame, dims: int, k: int) -> pd.DataFrame:
    """``query_id, vec_id, score, leaf`` of the calibration queries' neighbours among all rows."""
    ids, rows = asked["vec_id"].to_numpy(), matrix(asked["v"], dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        kept: list[tuple] = [none] * len(ids)
        for batch in batches:
            held, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            vectors = matrix(batch.column(1).to_pylist(), dims)
            for i, (own, q) in enumerate(zip(ids, rows)):
                other = held != own
                all_ids = np.concatenate([kept[i][0], held[other]])
                score = np.concatenate([kept[i][1], distances(vectors[other], q)])
                leaves = np.concatenate([kept[i][2], leaf[other]])
                first = best(score, all_ids, k)
                kept[i] = all_ids[first], score[first], leaves[first]
        n = np.array([len(x[0]) for x in kept], int)
        columns = [np.repeat(ids, n), *(np.concatenate([none[j], *(x[j] for x in kept)]) for j in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score", "leaf"])

    found = indexed.select("vec_id", "v", "leaf").mapInArrow(run, HITS + ", leaf LONG")
    return ranked(found, k, descending=False).toPandas()


def calibrate(tree: Tree, true: pd.DataFrame, asked: pd.DataFrame, recall: float) -> int:
    """The least number of leaf visits that finds ``recall`` of the true neighbours."""
    places = []
    for own, q in zip(asked["vec_id"], asked["v"]):
        wanted = true.loc[true["query_id"] == own, "leaf"].tolist()
        missing = set(wanted)
        place = {}
        for at, leaf in enumerate(tree.visit(np.frombuffer(q))):
            if leaf in missing:
                place[leaf] = at
                missing.discard(leaf)
            if not missing:
                break
        places += [place[leaf] for leaf in wanted]
    if not places:
        return tree.leaves
    return 1 + sorted(places)[max(0, int(np.ceil(recall * len(places))) - 1)]


def neighbours(embeddings: DataFrame, queries: Column, k: int = 10, recall: float = 0.97) -> DataFrame:
    """``query_id, rank, vec_id, score``: Euclidean neighbours of the rows ``queries`` holds for."""
    dims = dimensions(embeddings)
    packed = materialise(
        pack(embeddings, dims).where("length > 0").withColumn("asks", F.coalesce(queries, F.lit(False))), "vectors"
    )
    rows = packed.count()
    tree = fit(packed, dims, rows)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(matrix(batch.column(1).to_pylist(), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "v", "asks", "leaf"])

    indexed = materialise(
        packed.select("vec_id", "v", "asks").mapInArrow(index, "vec_id LONG, v BINARY, asks BOOLEAN, leaf LONG"), "leaves"
    )
    counts = indexed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).collect()
    held = {r["leaf"]: r["n"] for r in counts}
    asking = sum(r["q"] for r in counts)
    share = min(1 << 20, int((1 << 20) * CALIBRATION / max(asking, 1)) + 1)
    some = F.pmod(F.xxhash64("vec_id", F.lit("calibration")), F.lit(1 << 20)) < share
    asked = indexed.where("asks").where(some).select("vec_id", "v").toPandas().sort_values(["vec_id", "v"])
    asked = asked.drop_duplicates("vec_id")
    visits = calibrate(tree, _true_neighbours(indexed, asked, dims, k), asked, recall)
    chunks = {leaf: -(-n // BLOCK) for leaf, n in held.items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                room = 0
                for at, leaf in enumerate(tree.visit(np.frombuffer(v))):
                    # Widened where the visited leaves cannot fill the ranks.
                    if at >= visits and room > k:
                        break
                    room += held.get(leaf, 0)
                    out.append((i, v, leaf, at < FIRST))
            columns = list(zip(*out)) or [[]] * 4
            types = (pa.int64(), pa.binary(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "q", "leaf", "first"]
            )

    routed = indexed.where("asks").select("vec_id", "v").mapInArrow(route, "query_id LONG, q BINARY, leaf LONG, first BOOLEAN")
    routed = materialise(routed, "visits")
    # The nearest bins give each query a distance that the others have to beat.
    first = routed.where("first").withColumn("bound", F.lit(float("inf")))
    found = materialise(_search(indexed, first, chunks, dims, k), "first-hits")
    bounds = ranked(found, k, descending=False).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    others = routed.where("NOT first").join(materialise(bounds, "bounds"), "query_id", "left")
    others = others.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    hits = found.unionByName(_search(indexed, others, chunks, dims, k))
    return ranked(hits, k, descending=False).select("query_id", "rank", "vec_id", "score")


def _search(indexed: DataFrame, routed: DataFrame, chunks: dict[int, int], dims: int, k: int) -> DataFrame:
    """The ``k`` best within ``bound`` of every visit of a query to a block of a leaf's rows."""
    routed = materialise(routed.select("query_id", "q", "leaf", "bound"), "routed")
    # Leaves that many queries visit hand out copies of their rows, one for each block of queries.
    blocks = {r["leaf"]: -(-r["count"] // QUERIES) for r in routed.groupBy("leaf").count().collect()}

    def lookup(pairs: dict[int, int]) -> Column:
        sizes = F.create_map(*[F.lit(x) for p in (pairs or {-1: 1}).items() for x in p])
        return F.coalesce(F.element_at(sizes, F.col("leaf")), F.lit(0)).cast("int")

    def one_of(n: Column, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.greatest(n, F.lit(1))).cast("int")

    def each(n: Column) -> Column:
        return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))

    stored = indexed.select(
        "vec_id", "v", "leaf", one_of(lookup(chunks), "vec_id", "v").alias("chunk"), each(lookup(blocks)).alias("block")
    )
    visiting = routed.select(
        "query_id", "q", "bound", "leaf", one_of(lookup(blocks), "query_id").alias("block"), each(lookup(chunks)).alias("chunk")
    )

    def search(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"),
                             "score": pd.Series([], dtype="float64")})]
        if len(rows) and len(asks):
            ids, vectors, asked = rows["vec_id"].to_numpy(), matrix(rows["v"], dims), matrix(asks["q"], dims)
            lengths, own = (vectors**2).sum(axis=1), (asked**2).sum(axis=1)
            # Products choose who is measured; the slack is far above their rounding.
            rough = lengths[:, None] + own - 2 * vectors @ asked.T
            for j, (i, bound) in enumerate(zip(asks["query_id"], asks["bound"])):
                slack = 1e-9 * (lengths.max() + own[j])
                column = np.where(ids == i, np.inf, rough[:, j])
                kth = np.partition(column, k - 1)[k - 1] if len(column) > k else np.inf
                near = np.flatnonzero((column <= min(kth, bound * bound) + slack) & (ids != i))
                score = distances(vectors[near], asked[j])
                near, score = near[score <= bound], score[score <= bound]
                first = best(score, ids[near], k)
                if len(first):
                    out.append(pd.DataFrame({"query_id": i, "vec_id": ids[near][first], "score": score[first]}))
        return pd.concat(out, ignore_index=True)

    key = ["leaf", "chunk", "block"]
    return stored.groupBy(*key).cogroup(visiting.groupBy(*key)).applyInPandas(search, HITS)


def query(spark, folder: str) -> DataFrame:
    """Contract ``op8``: the ten nearest found of every hundredth vector."""
    return neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)
