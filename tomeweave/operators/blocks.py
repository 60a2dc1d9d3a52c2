"""The steps of ``logistic`` over arrays, for a fit whose numbers per class fit in one process.

The features of terms that two documents or more hold are packed into blocks of documents, as arrays
in a stored table. A step passes over them twice, in Python workers: once for what a direction adds
to each document's margins, once for the gradient by term, summed by ranges of terms on the
executors. The driver holds a number per term and per document for each class, at most ``NUMBERS`` of them.

A term that one document holds needs no pass. Whatever the loss, the weights of a document's own terms
are a multiple of their values, so they are one feature of that document, as long as theirs together,
and its norm in the gradient is theirs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.operators import logistic
from tomeweave.sources.workspace import broadcast_if_few, discard, materialise

# Features from which blocks are worth their workers.
LEAST = 10_000

# Weights of all classes at most, 64 MB; the driver's Python holds four to six times as much.
NUMBERS = 8_000_000

# Features of a block, about; a document is never parted.
BLOCK = 1_000_000

# Steps after which the preconditioner is made anew: the curvature falls as documents are told apart.
ANEW = (1, 3, 6, 10, 20, 40, 80)

# Terms of a range whose gradient is summed at once.
RANGE = 65_536


def suits(features: DataFrame, docs: DataFrame, key: str, label: str) -> DataFrame | None:
    """``term, df`` stored if the fit is large enough for blocks and small enough for the driver."""
    found = docs.agg(F.count("*"), F.count(key), F.countDistinct(key), F.countDistinct(label)).first()
    if len(set(found[:3])) > 1:
        return None  # documents are told apart by their key
    held = materialise(features.groupBy("term").agg(F.count("*").alias("df")), "term-documents")
    size = held.agg(F.sum("df"), F.count(F.when(F.col("df") > 1, 1))).first()
    if (size[0] or 0) < LEAST or (size[1] + found[0] + 1) * found[3] > NUMBERS:
        discard(held)
        return None
    return held


def _packed(vectors: DataFrame, size: int) -> DataFrame:
    """Rows ``row, y, own, ts, xs`` in blocks: their arrays, one after the other."""
    kind = vectors.schema["row"].dataType.simpleString()

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        first, done, parts, held = TaskContext.get().partitionId() << 32, 0, [], 0
        step = max(1, size // 4096)

        def block():
            nonlocal done, parts, held
            t = pa.Table.from_batches(parts).combine_chunks()
            lists = [t[c].combine_chunks() for c in ("ts", "xs")]
            out = {
                "block": [first + done], "rows": [t["row"].to_pylist()],
                "y": [t["y"].to_numpy().astype("i4").tobytes()], "own": [t["own"].to_numpy().astype("f8").tobytes()],
                "sizes": [np.diff(lists[0].offsets.to_numpy()).astype("i4").tobytes()],
                "ts": [lists[0].flatten().to_numpy().astype("i4").tobytes()],
                "xs": [lists[1].flatten().to_numpy().astype("f8").tobytes()],
            }
            done, parts, held = done + 1, [], 0
            kinds = {"block": pa.int64(), "rows": pa.list_(t.schema.field("row").type)}
            return pa.record_batch([pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()], names=list(out))

        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                parts.append(part)
                held += len(part.column("ts").flatten())
                if held >= size:
                    yield block()
        if parts:
            yield block()

    schema = f"block LONG, rows ARRAY<{kind}>, y BINARY, own BINARY, sizes BINARY, ts BINARY, xs BINARY"
    return vectors.mapInArrow(pack, schema)


class BlockFit:
    """Per class the weights ``w``, gradient ``g`` and last direction ``d`` of the terms, then of the documents'
    own features; the documents' margins ``m``, and what the last direction added to them, ``s``.

    A step goes to the least loss along three directions at once: the preconditioned gradient, the last
    direction, which makes it one of conjugate gradients, and the intercept.
    """

    def __init__(
        self, features: DataFrame, docs: DataFrame, key: str, label: str, value: str, c: float, strategy: str, held: DataFrame
    ):
        self.joint = strategy == "multinomial"
        sizes = {r[0]: r["n"] for r in docs.groupBy(label).agg(F.count("*").alias("n")).collect()}
        self.labels = tuple(sorted(x for x in sizes if x is not None))
        self.classes = range(len(self.labels))
        self.n = sum(sizes.values())
        self.penalty = 1.0 / (c * self.n)
        self.spark = spark = features.sparkSession
        self.cores = spark.sparkContext.defaultParallelism
        shared = held.where("df > 1").select("term", F.monotonically_increasing_id().alias("at"))
        shared = materialise(shared, "model-terms")
        # A number per task: the terms of the tasks before it.
        tasks, self.size = {}, 0
        for r in shared.groupBy(F.shiftright("at", 33).alias("task")).count().orderBy("task").collect():
            tasks[r["task"]], self.size = self.size - (r["task"] << 33), self.size + r["count"]
        before = F.create_map(*[F.lit(x) for pair in tasks.items() for x in pair]) if tasks else None
        number = (F.col("at") + before[F.shiftright("at", 33)]) if tasks else F.lit(0)
        self.terms = materialise(shared.select("term", number.cast("int").alias("t")), "model-terms")
        rows = features.select(F.col(key).alias("row"), "term", F.col(value).cast("double").alias("x"))
        numbered = rows.join(broadcast_if_few(self.terms), "term", "left")
        entries = F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "x")))
        own = F.sqrt(F.coalesce(F.sum(F.when(F.col("t").isNull(), F.col("x") * F.col("x"))), F.lit(0.0)))
        vectors = numbered.groupBy("row").agg(entries.alias("_es"), own.alias("_own"))
        names = F.array(*[F.lit(x) for x in self.labels])
        marked = docs.select(F.col(key).alias("row"), F.coalesce(F.array_position(names, F.col(label)), F.lit(0)).cast("int").alias("y"))
        vectors = marked.join(vectors, "row", "left").select(
            "row", "y", F.coalesce("_own", F.lit(0.0)).alias("own"),
            *[F.coalesce(F.col("_es")[f], F.array().cast(f"array<{kind}>")).alias(a) for a, f, kind in (("ts", "t", "int"), ("xs", "x", "double"))],
        )
        self.blocks = materialise(_packed(vectors, BLOCK), "blocks")
        for spent in (shared, held):
            discard(spent)
        # The documents' place in the arrays: blocks in the order of their numbers.
        self.places, y, own = {}, [], []
        at = 0
        for r in self.blocks.select("block", "y", "own").orderBy("block").collect():
            y.append(np.frombuffer(r["y"], "i4"))
            own.append(np.frombuffer(r["own"], "f8"))
            self.places[r["block"]] = (at, at + len(y[-1]))
            at += len(y[-1])
        self.y = np.concatenate(y) - 1 if y else np.zeros(0, "i4")
        self.own = np.concatenate(own) if own else np.zeros(0)
        width = self.size + self.n
        zeros = lambda size: [np.zeros(size) for _ in self.classes]
        self.w, self.g, self.d = zeros(width), zeros(width), zeros(width)
        self.m, self.s = zeros(self.n), zeros(self.n)
        self.p = zeros(width)
        self.intercepts = [0.0] * len(self.labels)

    def _passed(self, make, numbers) -> DataFrame:
        """Rows that workers make of the blocks and of ``numbers``, which each reads once."""
        return self.blocks.coalesce(self.cores).mapInArrow(make(numbers), "at LONG, k INT, v BINARY")

    def _reach(self, directions: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Per class, what the terms' part of a direction adds to each document's margin."""
        sent = self.spark.sparkContext.broadcast({k: d[: self.size] for k, d in directions.items()})

        def make(sent):
            def look(batches):
                import numpy as np
                import pyarrow as pa

                for batch in batches:
                    for b, sizes, ts, xs in zip(*(batch.column(c) for c in ("block", "sizes", "ts", "xs"))):
                        sizes, ts, xs = (np.frombuffer(v.as_buffer(), kind) for v, kind in ((sizes, "i4"), (ts, "i4"), (xs, "f8")))
                        rows, ts = np.repeat(np.arange(len(sizes)), sizes), ts.astype(np.intp)
                        made = [np.bincount(rows, d[ts] * xs, len(sizes)).astype("f8").tobytes() for d in sent.value.values()]
                        yield pa.record_batch([pa.array([b.as_py()] * len(made)), pa.array([*sent.value], pa.int32()), pa.array(made)], names=["at", "k", "v"])

            return look

        out = {k: np.zeros(self.n) for k in directions}
        for r in self._passed(make, sent).collect():
            start, end = self.places[r["at"]]
            out[r["k"]][start:end] = np.frombuffer(r["v"], "f8")
        sent.destroy()
        for k, d in directions.items():
            out[k] += self.own * d[self.size :]
        return out

    def _pull(self, factors: list[np.ndarray], powers: list[int]) -> list[np.ndarray]:
        """Of each factor per document, the sum by term of its product with the term's value, raised to the power."""
        size, step = self.size, RANGE
        sent = self.spark.sparkContext.broadcast({b: [r[i:j] for r in factors] for b, (i, j) in self.places.items()})

        def make(sent):
            def pull(batches):
                import numpy as np
                import pyarrow as pa

                sums = None
                for batch in batches:
                    for b, sizes, ts, xs in zip(*(batch.column(c) for c in ("block", "sizes", "ts", "xs"))):
                        sizes, ts, xs = (np.frombuffer(v.as_buffer(), kind) for v, kind in ((sizes, "i4"), (ts, "i4"), (xs, "f8")))
                        rows, ts, xs = np.repeat(np.arange(len(sizes)), sizes), ts.astype(np.intp), {1: xs, 2: xs * xs}
                        found = sent.value[b.as_py()]
                        sums = sums or [np.zeros(size) for _ in found]
                        for total, r, power in zip(sums, found, powers):
                            total += np.bincount(ts, r[rows] * xs[power], size)
                for k, total in enumerate(sums or []):
                    for at in range(0, size, step):
                        part = total[at : at + step]
                        if part.any():
                            yield pa.record_batch([pa.array([at]), pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=["at", "k", "v"])

            return pull

        def add(batches):
            import numpy as np
            import pyarrow as pa

            sums = {}
            for batch in batches:
                for at, k, v in zip(*(batch.column(c) for c in ("at", "k", "v"))):
                    place, part = (at.as_py(), k.as_py()), np.frombuffer(v.as_buffer(), "f8")
                    if place in sums:
                        sums[place] += part
                    else:
                        sums[place] = part.copy()
            for (at, k), total in sums.items():
                yield pa.record_batch([pa.array([at]), pa.array([k], pa.int32()), pa.array([total.tobytes()])], names=["at", "k", "v"])

        out = [np.zeros(size) for _ in factors]
        rows = self._passed(make, sent).repartition(self.cores, "at", "k").mapInArrow(add, "at LONG, k INT, v BINARY")
        for r in rows.collect():
            part = np.frombuffer(r["v"], "f8")
            out[r["k"]][r["at"] : r["at"] + len(part)] = part
        sent.destroy()
        return out

    def _rates(self, margins: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Probabilities per class; under softmax the margins are those of all classes."""
        with np.errstate(over="ignore"):
            if not self.joint:
                return {k: 1.0 / (1.0 + np.exp(-m)) for k, m in margins.items()}
        most = np.max([*margins.values()], axis=0)
        powers = {k: np.exp(m - most) for k, m in margins.items()}
        total = np.sum([*powers.values()], axis=0)
        return {k: x / total for k, x in powers.items()}

    def _loss(self, margins: dict[int, np.ndarray]) -> float:
        if self.joint:
            most = np.max([*margins.values()], axis=0)
            loss = most + np.log(np.sum([np.exp(m - most) for m in margins.values()], axis=0))
            return float((loss - sum((self.y == k) * m for k, m in margins.items())).mean())
        return float(sum((np.logaddexp(0.0, m) - (self.y == k) * m).mean() for k, m in margins.items()))

    def _gradient(self, classes: Sequence[int], anew: bool) -> None:
        """The gradient where the margins are; ``anew``, the preconditioner too, the curvature's diagonal."""
        rates = self._rates({k: self.m[k] for k in (self.classes if self.joint else classes)})
        residuals = [(rates[k] - (self.y == k)) / self.n for k in classes]
        bends = [rates[k] * (1.0 - rates[k]) / self.n for k in classes] if anew else []
        pulls = self._pull([*residuals, *bends], [1] * len(residuals) + [2] * len(bends))
        for k, r in zip(classes, residuals):
            self.g[k] = np.concatenate([pulls.pop(0), self.own * r])
            self.g[k] += self.penalty * self.w[k]
            self.norms[k] = math.hypot(np.linalg.norm(self.g[k]), r.sum())
        for k, h in zip(classes, bends):
            self.p[k] = np.concatenate([pulls.pop(0), self.own**2 * h])
            self.p[k] += self.penalty
            np.reciprocal(self.p[k], out=self.p[k])

    def _best(self, classes: Sequence[int], fresh: dict, reached: dict) -> np.ndarray:
        """Lengths per class along the fresh direction, the last one and the intercept at which the loss is least.

        Newton's steps over three numbers a class; all that they need of the terms is the directions' products.
        """
        basis = {k: np.stack([reached[k], self.s[k], np.ones(self.n)]) for k in classes}
        weights = {}
        for k in classes:
            three = (self.w[k], fresh[k], self.d[k])
            weights[k] = np.array([[self.penalty * float(x @ y) for y in three] for x in three])
        wide = 3 * len(classes)

        def at(c):
            return {k: self.m[k] + c[3 * i : 3 * i + 3] @ basis[k] for i, k in enumerate(classes)}

        def cost(c, margins):
            total = self._loss(margins)
            for i, k in enumerate(classes):
                v = np.array([1.0, *c[3 * i : 3 * i + 2]])
                total += 0.5 * float(v @ weights[k] @ v)
            return total

        c = np.zeros(wide)
        margins = at(c)
        now = cost(c, margins)
        for _ in range(30):
            rates = self._rates(margins)
            slope, bend = np.zeros(wide), np.zeros((wide, wide))
            for i, k in enumerate(classes):
                here = slice(3 * i, 3 * i + 3)
                slope[here] = basis[k] @ (rates[k] - (self.y == k)) / self.n
                v = np.array([1.0, *c[3 * i : 3 * i + 2]])
                slope[3 * i : 3 * i + 2] += (weights[k] @ v)[1:]
                for j, o in enumerate(classes):
                    if k == o or self.joint:
                        by = rates[k] * ((k == o) - rates[o]) / self.n
                        bend[here, 3 * j : 3 * j + 3] = (basis[k] * by) @ basis[o].T
                bend[3 * i : 3 * i + 2, 3 * i : 3 * i + 2] += weights[k][1:, 1:]
            # Directions differ in length; one that is zero, or depends upon others, moves nothing.
            scale = np.sqrt(np.maximum(np.diag(bend), 1e-300))
            step = -np.linalg.lstsq(bend / np.outer(scale, scale), slope / scale, rcond=1e-12)[0] / scale
            gain = -float(slope @ step)
            length = 1.0
            while length > 1e-6:
                margins = at(c + length * step)
                then = cost(c + length * step, margins)
                if then <= now - 1e-4 * length * gain:
                    break
                length /= 2
            else:
                break
            c, now = c + length * step, then
            if gain < 1e-12 * abs(now):
                break
        return c.reshape(-1, 3)

    def run(self, tol: float, max_steps: int, features: DataFrame, key: str, value: str) -> logistic.TableModel:
        self.norms = [0.0] * len(self.labels)
        self._gradient(self.classes, True)
        at_zero, steps = [*self.norms], 0
        while steps < max_steps:
            left = [k for k in self.classes if self.norms[k] > tol * at_zero[k]]
            if not left:
                break
            # A class that has converged stays where it is, unless all move together.
            left = [*self.classes] if self.joint else left
            fresh = {k: -self.p[k] * self.g[k] for k in left}
            reached = self._reach(fresh)
            for part in [left] if self.joint else [[k] for k in left]:
                for k, (a, b, c) in zip(part, self._best(part, fresh, reached)):
                    for kept, new in ((self.d[k], fresh[k]), (self.s[k], reached[k])):
                        kept *= b
                        new *= a
                        kept += new
                    self.w[k] += self.d[k]
                    self.m[k] += self.s[k] + c
                    self.intercepts[k] += float(c)
            del fresh, reached
            steps += 1
            self._gradient(left, steps in ANEW)
        weights = self._end(features, key, value)
        return logistic.TableModel(self.labels, tuple(self.intercepts), weights, steps, tuple(self.norms), tuple(at_zero))

    def _rows(self, columns: dict, kinds: dict, name: str) -> DataFrame:
        """Arrays as a stored table, some rows at a time."""
        table = pa.table({c: pa.array(v, kinds[c]) for c, v in columns.items()})
        stored = None
        for at in range(0, max(1, table.num_rows), 500_000):
            part = materialise(self.spark.createDataFrame(table.slice(at, 500_000)), name)
            stored = part if stored is None else stored.unionByName(part)
        return stored

    def _end(self, features: DataFrame, key: str, value: str) -> DataFrame:
        """The stored weights; the other tables are deleted."""
        names, size = [f"w{k}" for k in self.classes], self.size
        kinds = {x: pa.float64() for x in names} | {"t": pa.int32(), "block": pa.int64(), "pos": pa.int32(), "own": pa.float64()}
        shared = self._rows({"t": np.arange(size)} | {x: self.w[k][:size] for k, x in enumerate(names)}, kinds, "term-weights")
        found = self.terms.join(shared, "t").select("term", *names)
        # A term of one document has its value's part of the document's own feature.
        block = np.concatenate([np.full(j - i, b) for b, (i, j) in self.places.items()])
        pos = np.concatenate([np.arange(j - i) for i, j in self.places.values()])
        some = self.own > 0
        columns = {"block": block[some], "pos": pos[some]} | {x: self.w[k][size:][some] / self.own[some] for k, x in enumerate(names)}
        own = self._rows(columns, kinds, "own-weights")
        rows = self.blocks.select("block", F.posexplode("rows").alias("pos", "row")).join(own, ["block", "pos"]).select("row", *names)
        singles = features.select(F.col(key).alias("row"), "term", F.col(value).cast("double").alias("x"))
        singles = singles.join(self.terms, "term", "left_anti").join(rows, "row", "left")
        singles = singles.select("term", *[F.coalesce(F.col("x") * F.col(x), F.lit(0.0)).alias(x) for x in names])
        weights = materialise(found.unionByName(singles), "model")
        for spent in (shared, own, self.blocks, self.terms):
            discard(spent)
        return weights
