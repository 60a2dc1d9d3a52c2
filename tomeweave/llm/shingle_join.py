"""N-gram Jaccard join of whole documents, through R-trees over count vectors.

A document is the set of its distinct word shingles. The shingles are hashed into groups, and the
numbers per group are the document's point. No two sets share more than the sum, over the groups,
of the smaller of their numbers; a tree whose nodes keep the largest numbers below them bounds that
for all points of a branch at once, and branches that cannot reach the overlap a link needs are
not entered. What survives is verified on the sets themselves. A set has about a quarter as many
groups as shingles, a power of two, without which long documents would all look alike; points of
neighbouring resolutions are compared at the coarser one, by adding up groups.

One tree over all documents would be entered nearly everywhere, as documents of one length have
nearly the same counts. So documents are dealt to many trees by rare shingles: two sets linked at
similarity t share one of the first n - ceil(t n) + 1 shingles of any fixed order, and the order
puts common shingles last, by a count sketch over all documents. A tree holds the documents of one
shingle; trees of the same documents are one. Equal sets are one point throughout.

Large trees are first probed from one pivot, which joins groups of near copies in linear time.
What is left in more than one class is cut into blocks; points meet block by block, points of one
class are never compared, and a branch of the query's own class is not entered. Points that the
bound leaves with a partner form clusters, and only these are compared by their texts, joining
classes as they go. So no group is paired out, whatever its size. Links become classes by
alternating stars.

Defined results: NULL texts and texts without words have an empty set and are linked with nothing.
Texts of fewer words than a shingle are one shingle as a whole. A document's component is the
least id that links reach; NULL ids are never the least, and rows of equal id are documents each.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.llm.common import released, ship, small, table
from tomeweave.llm.components import components
from tomeweave.llm.shingles import mix, shingle_sets
from tomeweave.sources.workspace import materialise

# A link: NEED[0] * intersection >= NEED[1] * union.
NEED = (100, 75)
# Groups: powers of two from 2 ** 7 to 2 ** 16; a count that does not fit a byte is no bound.
FINEST, COARSEST, FULL, MANY = 16, 7, 255, 1 << 14
# Counters of the sketch that tells common shingles, and rows of it that are added up together.
COUNTERS, SLOTS = 1 << 18, 16
# Points of a leaf and branches of a node; groups up to a leaf are compared point by point.
LEAF = 16
# Points of a block.
BLOCK = 1024
# Pairs compared together and sets kept for the next, characters hashed together, rows up to which a stored narrow table is broadcast.
PAIRS, KEPT, CHARACTERS, SMALL = 64, 256, 1_000_000, 500_000


def overlap_needed(a, b):
    """Shared shingles that link sets of these sizes: from 100 I >= 75 (a + b - I), rounded up."""
    return -(-NEED[1] * (a + b) // (NEED[0] + NEED[1]))


def prefix_length(n: int) -> int:
    """How many of a set's first shingles any linked set must meet."""
    return n - -(-NEED[1] * n // NEED[0]) + 1


def points(shingles: np.ndarray) -> bytes:
    """Numbers per group, a byte each."""
    bits = COARSEST
    while bits < FINEST and 4 << bits < len(shingles):
        bits += 1
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def unpacked(packed: list[bytes], groups: int) -> np.ndarray:
    """Points of one resolution, added up to ``groups`` groups."""
    rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1).astype(np.uint16)
    rows[rows == FULL] = MANY
    if rows.shape[1] > groups:
        rows = rows.reshape(len(rows), groups, -1).sum(axis=2, dtype=np.uint16)
    return rows


def signature(shingles: np.ndarray) -> int:
    """A 64-bit name of the set."""
    total = shingles.sum(dtype=np.uint64) + np.uint64(len(shingles))
    both = mix(np.array([total ^ mix(np.array([np.bitwise_xor.reduce(shingles)], np.uint64))[0]], np.uint64))
    return int(both.astype(np.int64)[0])


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    """Ids, hashes and shingle sets of ``doc_id, th, text``, some characters at a time."""
    for batch in batches:
        ids, hashes, texts, size = [], [], [], 0
        for i, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py() or ""
            ids.append(i)
            hashes.append(th)
            texts.append(text)
            size += len(text)
            if size >= CHARACTERS:
                yield ids, hashes, shingle_sets(texts)
                ids, hashes, texts, size = [], [], [], 0
        yield ids, hashes, shingle_sets(texts)


def _counter(shingles: np.ndarray) -> np.ndarray:
    return ((shingles >> np.uint64(20)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def describe(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, th, n, sig, point`` of every document (``th`` a hash of its text), and the rank of
    every counter of the sketch."""
    spark = docs.sparkSession
    ship(spark)
    names = ["doc_id", "th", "n", "sig", "point", "slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(COUNTERS, np.uint32)
        for ids, hashes, sets in _texts(batches):
            if any(len(s) for s in sets):
                sketch += np.bincount(_counter(np.concatenate(sets)), minlength=COUNTERS).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([points(s) for s in sets], pa.binary()), pa.nulls(len(ids), pa.int32()),
                ],
                names=names,
            )
        if sketch.any():
            parts = [p.tobytes() for p in sketch.reshape(SLOTS, -1)]
            nothing = pa.nulls(SLOTS, pa.int64())
            slots = pa.array(range(SLOTS), pa.int32())
            yield pa.RecordBatch.from_arrays([nothing] * 4 + [pa.array(parts, pa.binary()), slots], names=names)

    rows = _hashed(docs).mapInArrow(released(run), "doc_id LONG, th LONG, n LONG, sig LONG, point BINARY, slot INT")
    rows = materialise(rows, "sets")

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTERS // SLOTS, np.uint64)
        for part in group["point"]:
            total += np.frombuffer(part, np.uint32)
        ranks = (4 * np.log2(total + 1)).round().astype(np.uint8)
        return pd.DataFrame({"slot": group["slot"].iloc[:1], "ranks": [ranks.tobytes()]})

    tallies = rows.where("slot IS NOT NULL").select("slot", "point")
    # A fixed number of counters, one byte each.
    ranks = {r["slot"]: r["ranks"] for r in tallies.groupBy("slot").applyInPandas(added, "slot INT, ranks BINARY").collect()}
    blank = bytes(COUNTERS // SLOTS)
    order = np.frombuffer(b"".join(ranks.get(i, blank) for i in range(SLOTS)), np.uint8)
    return rows.where("slot IS NULL").drop("slot"), order


def _prefixes(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """``key, sig``: the rarest shingles of every set, as many as the join needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sets in _texts(batches):
            keys, sigs, seen = [], [], set()
            for s in sets:
                sig = signature(s) if len(s) else None
                if sig is None or sig in seen:
                    continue
                seen.add(sig)
                first = np.lexsort((s, order[_counter(s)]))[: prefix_length(len(s))]
                keys.append(s[first].astype(np.int64))
                sigs.append(np.full(len(first), sig, np.int64))
            if keys:
                columns = [pa.array(np.concatenate(x)) for x in (keys, sigs)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "sig"])

    return _hashed(docs).mapInArrow(released(run), "key LONG, sig LONG")


def trees(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """``tree, sig``: which sets meet; one tree for all shingles of the same sets."""
    by_key = Window.partitionBy("key")
    one = F.xxhash64("sig").cast("decimal(20,0)")
    held = _prefixes(docs, order).select(
        "sig",
        F.min("sig").over(by_key).alias("least"),
        F.max("sig").over(by_key).alias("most"),
        F.xxhash64(F.count("*").over(by_key), F.sum(one).over(by_key)).alias("tree"),
    )
    return materialise(held.where("least <> most").select("tree", "sig").distinct(), "trees")


def _texts_of(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sig, text`` of the wanted sets, from one document each.

    Texts are sent and their shingles hashed again where they are compared: they are half as long
    as the hashes, and unlike them can be compressed.
    """
    wanted = materialise(wanted.select("sig").distinct(), "wanted")
    holders = sets.where("sig IS NOT NULL").join(small(wanted, SMALL), "sig", "left_semi")
    holders = holders.groupBy("sig").agg(F.min(F.struct("doc_id", "th")).alias("of")).select("sig", "of.*")
    holders = materialise(holders, "holders")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.th") == F.col("h.th"))
    found = _hashed(docs).alias("d").join(small(holders, SMALL).alias("h"), same).select("sig", "text")
    # Rows of equal id and text are the same set.
    return materialise(found.groupBy("sig").agg(F.first("text").alias("text")), "texts")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) >= overlap_needed(len(a), len(b))


def _with_end(rows: DataFrame, end: str, held: DataFrame, value: str, name: str) -> DataFrame:
    return rows.join(held.select(F.col("sig").alias(end), F.col(value).alias(name)), end)


def bounded(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of set names whose sizes and points allow a link."""
    sizes = _with_end(_with_end(pairs, "a", ends, "n", "na"), "b", ends, "n", "nb")
    near = sizes.where(F.least("na", "nb") * NEED[0] >= F.greatest("na", "nb") * NEED[1])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = overlap_needed(batch.column(2).to_numpy(), batch.column(3).to_numpy())
            x, y = np.array(batch.column(4).to_pylist(), object), np.array(batch.column(5).to_pylist(), object)
            kinds = np.array([[len(p) for p in x], [len(p) for p in y]]).reshape(2, -1)
            ok = np.zeros(batch.num_rows, bool)
            for gx, gy in set(map(tuple, kinds.T.tolist())):
                rows = np.flatnonzero((kinds[0] == gx) & (kinds[1] == gy))
                for at in np.array_split(rows, -(-len(rows) * max(gx, gy) // (1 << 22))):
                    low = min(gx, gy)
                    shared = np.minimum(unpacked(x[at].tolist(), low), unpacked(y[at].tolist(), low))
                    ok[at] = shared.sum(axis=1, dtype=np.int64) >= sizes[at]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    both = _with_end(_with_end(near, "a", ends, "point", "x"), "b", ends, "point", "y")
    both = both.select("a", "b", "na", "nb", "x", "y")
    return materialise(both.mapInArrow(released(bound), "a LONG, b LONG"), "candidates")


def compared(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs whose sets are linked, by the texts in ``sig, text``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            ok: list[bool] = []
            held: dict[int, np.ndarray] = {}
            for at in range(0, len(rows), PAIRS):
                part = rows[at : at + PAIRS]
                texts = {i: t for a, b, x, y in part for i, t in ((a, x), (b, y)) if i not in held}
                if len(held) > KEPT:
                    held, texts = {}, {i: t for a, b, x, y in part for i, t in ((a, x), (b, y))}
                held.update(zip(texts, shingle_sets(list(texts.values()))))
                ok += [linked(held[a], held[b]) for a, b, _, _ in part]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    both = _with_end(_with_end(pairs, "b", whole, "text", "y"), "a", whole, "text", "x")
    both = both.sortWithinPartitions("a").select("a", "b", "x", "y")
    return materialise(both.mapInArrow(released(compare), "a LONG, b LONG"), "links")


def verified(docs: DataFrame, sets: DataFrame, ends: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links among the pairs that join what all links among them join.

    Each set is compared with its least candidate first. Of the other pairs those need no
    comparison whose ends are linked to the same least candidate.
    """
    may = bounded(pairs, ends)
    whole = _texts_of(docs, sets, may.select(F.explode(F.array("a", "b")).alias("sig")))
    forest = materialise(may.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "forest")
    first = compared(forest, whole)
    least = forest.select("b", F.col("a").alias("tried"))
    hung = first.select("b", F.col("a").alias("under"))
    rest = (
        may.join(small(least, SMALL), "b")
        .join(small(hung, SMALL), "b", "left")
        .join(small(hung.select(F.col("b").alias("a"), F.col("under").alias("over")), SMALL), "a", "left")
        .where("a <> tried AND coalesce(over, a) <> coalesce(under, b)")
    )
    return first.unionByName(compared(materialise(rest.select("a", "b"), "rest"), whole))


class CountTree:
    """An R-tree over count vectors, packed by size; nodes keep the upper corner of their points."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, classes: np.ndarray):
        # Neighbours in size, then in their strongest groups, share a leaf.
        self.order = np.lexsort((rows.argmax(axis=1), sizes))
        self.rows, self.sizes, self.classes = rows[self.order], sizes[self.order], classes[self.order]
        node = self.rows, self.sizes, self.sizes, self.classes, self.classes
        self.levels = []
        while len(node[0]) > 1:
            cuts = np.arange(0, len(node[0]), LEAF)
            least, most = np.minimum.reduceat, np.maximum.reduceat
            node = (
                most(node[0], cuts, axis=0), least(node[1], cuts), most(node[2], cuts),
                least(node[3], cuts), most(node[4], cuts),
            )
            self.levels.append(node)

    def search(self, row: np.ndarray, size: int, own: int) -> np.ndarray:
        """Indices of the points of other classes that may be linked to a point: all that are, too."""
        at = np.zeros(1, int) if self.levels else np.arange(len(self.rows))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high, first, last = self.levels[depth]
            near = (NEED[0] * high[at] >= NEED[1] * size) & (NEED[1] * low[at] <= NEED[0] * size)
            at = at[near & ~((first[at] == own) & (last[at] == own))]
            shared = np.minimum(corner[at], row).sum(axis=1, dtype=np.int64)
            at = at[shared >= overlap_needed(low[at], size)]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < (len(self.levels[depth - 1][0]) if depth else len(self.rows))]
        at = at[self.classes[at] != own]
        shared = np.minimum(self.rows[at], row).sum(axis=1, dtype=np.int64)
        return self.order[at[shared >= overlap_needed(self.sizes[at], size)]]


class Trees:
    """A tree for each resolution that is asked for, over its points and those of the next finer one.

    Linked sets differ by a third in size at most, and so by one resolution.
    """

    def __init__(self, packed: list[bytes], sizes: np.ndarray, classes: np.ndarray):
        self.packed, self.sizes, self.classes = packed, sizes, classes
        self.groups = np.array([len(p) for p in packed], int)
        self.present = set(self.groups.tolist())
        self.trees: dict[int, tuple[np.ndarray, CountTree]] = {}

    def _tree(self, g: int) -> tuple[np.ndarray, CountTree]:
        if g not in self.trees:
            held = [np.flatnonzero(self.groups == x) for x in (g, 2 * g)]
            rows = np.concatenate([unpacked([self.packed[i] for i in h], g) for h in held if len(h)])
            held = np.concatenate(held)
            self.trees[g] = held, CountTree(rows, self.sizes[held], self.classes[held])
        return self.trees[g]

    def search(self, packed: bytes, size: int, own: int) -> np.ndarray:
        found = []
        for g in (len(packed), len(packed) // 2):
            # Finer points are found at the query's own resolution, whether or not others have it.
            if g in self.present or (g == len(packed) and 2 * g in self.present):
                held, tree = self._tree(g)
                at = held[tree.search(unpacked([packed], g)[0], size, own)]
                found.append(at if g == len(packed) else at[self.groups[at] == g])
        return np.concatenate(found) if found else np.zeros(0, int)


def _trees(block: pd.DataFrame) -> Trees:
    return Trees(block["point"].tolist(), block["n"].to_numpy(), block["class"].to_numpy())


class Forest:
    """Classes that become one as links are found."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, c: int) -> int:
        root = self.root
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)
        return a != b


def _promising(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Pairs of points of two blocks and of other classes that may be linked: as many as it takes
    to join all that such pairs join, so that every point with a partner is in one of them."""
    links: list[tuple[int, int]] = []
    if len(left) and len(right):
        forest, trees_, names = Forest(), _trees(right), right["sig"].to_numpy()
        for sig, n, point, own in zip(left["sig"], left["n"], left["point"], left["class"]):
            for other in names[trees_.search(point, n, own)].tolist():
                if forest.join(int(sig), other):
                    links.append((int(sig), other))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _joined(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks that join classes; classes joined on the way are one from then on."""
    links: list[tuple[int, int]] = []
    if len(left) and len(right):
        forest, trees_ = Forest(), _trees(right)
        names, classes = right["sig"].to_numpy(), right["class"].to_numpy()
        sets = shingle_sets(right["text"].tolist())
        mine = sets if left is right else shingle_sets(left["text"].tolist())
        for k, (sig, n, point, own) in enumerate(zip(left["sig"], left["n"], left["point"], left["class"])):
            for i in trees_.search(point, n, own):
                a, b = int(own), int(classes[i])
                if forest.find(a) != forest.find(b) and linked(mine[k], sets[i]):
                    forest.join(a, b)
                    links.append((int(sig), int(names[i])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tree, block, ...`` of the members, and the pairs of blocks that have to meet.

    A class that fills blocks of its own is cut by name; smaller classes share blocks. Two blocks
    of one class never meet.
    """
    sizes = members.groupBy("tree", "class").agg(F.count("*").alias("c"))
    sizes = materialise(sizes, "tree-classes")
    loose = sizes.groupBy("tree").agg(F.sum(F.when(F.col("c") <= BLOCK, F.col("c")).otherwise(0)).alias("loose"))
    loose = materialise(loose, "tree-loose")
    cut = F.ceil(F.col("c") / BLOCK)
    own = F.concat_ws("/", "class", F.pmod(F.xxhash64("sig"), cut))
    shared = F.concat_ws("/", F.lit("shared"), F.pmod(F.xxhash64("class"), F.greatest(F.lit(1), F.ceil(F.col("loose") / BLOCK))))
    dealt = members.join(sizes, ["tree", "class"]).join(loose, "tree").select(
        *members.columns,
        F.when(F.col("c") > BLOCK, own).otherwise(shared).alias("block"),
        F.when(F.col("c") > BLOCK, F.col("class")).alias("pure"),
    )
    dealt = materialise(dealt, "tree-blocks")
    blocks = materialise(dealt.select("tree", "block", "pure").distinct(), "tree-block-list")
    a, b = blocks.alias("a"), blocks.alias("b")
    meet = a.join(b, "tree").where("a.block <= b.block AND NOT coalesce(a.pure = b.pure, false)")
    return dealt.drop("pure"), materialise(meet.select("tree", F.col("a.block").alias("left"), F.col("b.block").alias("right")), "tree-meet")


def _meeting(dealt: DataFrame, meet: DataFrame, run, schema: str) -> DataFrame:
    def alone(a: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("sig", ignore_index=True)
        return run(a, a)

    # A block that meets itself is sent once.
    own = dealt.join(meet.where("left = right").select("tree", F.col("left").alias("block")), ["tree", "block"])
    own = own.groupBy("tree", "block").applyInPandas(alone, schema)
    meet = meet.where("left <> right")
    key = ["tree", "left", "right"]
    left = dealt.join(meet.withColumnRenamed("left", "block"), ["tree", "block"]).withColumnRenamed("block", "left")
    right = dealt.join(meet.withColumnRenamed("right", "block"), ["tree", "block"]).withColumnRenamed("block", "right")
    # Both sides come from one table; the second gets columns of its own.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return run(a.sort_values("sig", ignore_index=True), b.sort_values("sig", ignore_index=True))

    return own.unionByName(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(both, schema))


def classes_of(docs: DataFrame, sets: DataFrame, order: np.ndarray) -> DataFrame:
    """``node, component``: the sets that links join, by name, and the class each is in."""
    held = trees(docs, order)
    sizes = materialise(held.groupBy("tree").agg(F.count("*").alias("size"), F.min("sig").alias("pivot")), "tree-sizes")
    members = materialise(held.select("sig").distinct(), "tree-members")
    ends = sets.where("sig IS NOT NULL").join(small(members, SMALL), "sig", "left_semi")
    ends = materialise(ends.groupBy("sig").agg(F.first("n").alias("n"), F.first("point").alias("point")), "end-points")
    # Up to a leaf, every point of a tree meets every other; larger trees are first probed by their least.
    few = materialise(held.join(sizes.where(F.col("size") <= LEAF).select("tree"), "tree"), "small-trees")
    pairs = few.alias("x").join(few.alias("y"), "tree").where("x.sig < y.sig").select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"))
    # Large trees of one pivot hold much the same sets: they are one tree from here on.
    large = held.join(sizes.where(F.col("size") > LEAF).select("tree", "pivot"), "tree")
    large = materialise(large.select(F.col("pivot").alias("tree"), "sig").distinct(), "large-trees")
    pairs = pairs.unionByName(large.where("tree <> sig").select(F.col("tree").alias("a"), F.col("sig").alias("b")))
    first = verified(docs, sets, ends, materialise(pairs.distinct(), "pairs"))
    classes = materialise(components(first), "link-classes")
    classed = large.join(classes, F.col("sig") == F.col("node"), "left").select("tree", "sig", F.coalesce("component", "sig").alias("class"))
    classed = materialise(classed, "classed")
    open_ = classed.groupBy("tree").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("tree")
    members = classed.join(small(materialise(open_, "open-trees"), SMALL), "tree", "left_semi")
    members = materialise(members.join(ends, "sig"), "members")
    if members.isEmpty():
        return classes
    dealt, meet = _blocks(members)
    # Points that may be linked to another class, in clusters that no link leaves.
    promising = materialise(_meeting(dealt, meet, _promising, "a LONG, b LONG").distinct(), "promising")
    clusters = materialise(components(promising), "clusters")
    whole = _texts_of(docs, sets, clusters.select(F.col("node").alias("sig")))
    left = clusters.select(F.col("component").alias("tree"), F.col("node").alias("sig"))
    left = left.join(ends, "sig").join(classes.withColumnRenamed("node", "sig"), "sig", "left")
    left = left.withColumn("class", F.coalesce("component", "sig")).drop("component")
    dealt, meet = _blocks(materialise(left.join(whole, "sig"), "left-over"))
    second = materialise(_meeting(dealt, meet, _joined, "a LONG, b LONG").distinct(), "links")
    if second.isEmpty():
        return classes
    # Classes that the second round joins; a set that had no class is one of its own.
    ends_ = second
    for end in ("a", "b"):
        named = small(classes.select(F.col("node").alias(end), F.col("component").alias("c")), SMALL)
        ends_ = ends_.join(named, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    joined = materialise(components(ends_), "joined-classes")
    alone = joined.select("node", F.col("node").alias("component")).join(small(classes, SMALL), "node", "left_anti")
    merged = small(joined.select(F.col("node").alias("component"), F.col("component").alias("c")), SMALL)
    return classes.unionByName(alone).join(merged, "component", "left").select("node", F.coalesce("c", "component").alias("component"))


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, th, n_shingles, component_id, class``: a row per document."""
    sets, order = describe(docs)
    classes = materialise(classes_of(docs, sets, order), "classes")
    rows = sets.join(small(classes, SMALL), F.col("sig") == F.col("node"), "left").select(
        "doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component", "sig").alias("class")
    )
    rows = materialise(rows, "document-classes")
    # Classes of one document need no join back.
    several = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    several = materialise(several.where("c > 1").drop("c"), "several")
    return rows.join(small(several, SMALL), "class", "left").select(
        "doc_id", "th", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "class"
    )


def query(spark, folder: str) -> DataFrame:
    """Contract ``op5``: the component of every document."""
    return near_copies(table(spark, folder, "documents")).drop("th", "class")


def kept(docs: DataFrame) -> DataFrame:
    """One document of every component, that of the least id, then text hash; columns as they were.

    NULL ids come last. Of rows of equal id and text one stays. Documents of no words all stay.
    """
    found = materialise(near_copies(docs).where("class IS NOT NULL").select("doc_id", "th", "class"), "components")
    here = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    first = found.groupBy("class").agg(F.min(here).alias("first"), F.count("*").alias("c"))
    first = materialise(first.where("c > 1").drop("c"), "first-copies")
    grouped = materialise(found.join(small(first, SMALL), "class").select("doc_id", "th", here.eqNullSafe(F.col("first")).alias("stays")), "grouped")
    counts = grouped.groupBy("doc_id", "th", "stays").agg(F.count("*").alias("c"))
    named = materialise(counts.where("NOT stays OR c > 1").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "stays"), "copies")
    text_hash = F.xxhash64("text")

    def held(which: str, how: str) -> DataFrame:
        some = named.where(which).select("_id", "_th")
        return docs.join(small(some, SMALL), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_hash == F.col("_th")), how)

    alone = held("true", "left_anti").select(*docs.columns)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    twins = held("stays", "left_semi").select("doc_id", text_hash.alias("_th"), own.alias("row"))
    one = twins.groupBy("doc_id", "_th").agg(F.first("row").alias("row")).select("row.*")
    return alone.unionByName(one)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
    ELSE [] END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(s) AS n FROM words LEFT JOIN sets USING (doc_id) GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), linked AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * i >= 75 * (x.n + y.n - i)
), both_ways AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION
  SELECT r.a, l.b FROM reached r JOIN both_ways l ON l.a = r.b
)
SELECT doc_id, n AS n_shingles, min(b) AS component_id
FROM sizes JOIN reached ON a = doc_id GROUP BY doc_id, n
"""
