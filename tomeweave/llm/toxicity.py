"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A text's features are its distinct words and their first letters, hashed. One weight vector is
shared by all grades; ordered thresholds part the score into them: P(grade <= k) =
sigmoid(threshold_k - score). The expected grade is a document's severity.

The model is fitted on a bounded sample of labelled rows, SAMPLE, chosen by a hash of their ids;
features are counted over that sample and those most tied to the grade are kept, FEATURES at
most. Scoring reads every document whole.

Defined results: NULL and empty texts have no features and the score 0. Rows with NULL labels or
ids are not learned from; of several labels of one id the highest counts. If the sample holds one
grade only, every document gets that grade (0 if there are no labels). Equal rows get equal
scores; an empty table gives no rows. Further columns of the documents are kept, and those named
like a result are replaced by it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.common import released, ship, table
from tomeweave.sources.workspace import materialise

# Labelled rows to learn from and features to keep, at most about.
SAMPLE, FEATURES = 8192, 2048
# A feature is kept from this chi-square with the toxic label, and from so many documents.
TIED, SUPPORT = 20.0, 4
BITS = 20
PENALTY = 2e-5
STEPS, RATE = 300, 0.1
MARKS = ".,;:!?%$#&*()[]{}\"'`-"
# Words whose features a task remembers.
REMEMBERED = 300_000


def features_of(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its first three, four and five letters."""
    w = word.strip(MARKS)
    names = {f"w{w}", f"3{w[:3]}", f"4{w[:4]}", f"5{w[:5]}"} if w else ()
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for n in names)


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def featured(rows: DataFrame) -> DataFrame:
    """``doc_id, ids``: the distinct features of every text."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for text in batch.column(1):
                found: set[int] = set()
                for w in words_of(text.as_py()):
                    found.update(features_of(w))
                ids.append(sorted(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows.select("doc_id", "text").mapInArrow(released(run), "doc_id LONG, ids ARRAY<INT>")


def screened(rows: DataFrame, keep: int = FEATURES) -> list[int]:
    """The features of ``grade, ids`` rows most tied to a grade above 0."""
    totals = rows.agg(F.count("*").alias("n"), F.sum((F.col("grade") > 0).cast("long")).alias("p")).first()
    n, p = totals["n"], totals["p"] or 0
    if not 0 < p < n:
        return []
    share = p / n
    counts = rows.select(F.explode("ids").alias("id"), (F.col("grade") > 0).cast("long").alias("toxic"))
    held = counts.groupBy("id").agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).where(F.col("n") >= SUPPORT)
    off = F.col("p") - F.col("n") * share
    tied = off * off / (F.col("n") * share * (1 - share) * (1 - F.col("n") / (n + 1)))
    best = held.select("id", tied.alias("tied")).where(F.col("tied") >= TIED)
    return sorted(r["id"] for r in best.orderBy(F.col("tied").desc(), "id").limit(keep).collect())


@dataclass(frozen=True)
class Ordinal:
    """Weights by feature, and the thresholds between the grades 0, 1, ..."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]
    only: int = 0  # the grade of all documents where there are no thresholds

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k, one row per score."""
        t = np.array(self.thresholds)
        return 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -50, 50)))


def fit_ordinal(index: np.ndarray, row: np.ndarray, grade: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised loss, by full-batch Adam.

    ``index`` and ``row`` list the features that each row holds. Thresholds after the first are
    sums of positive steps, which keeps them in order.
    """
    n, top = len(grade), int(grade.max())
    above = np.array([(grade > k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    cuts = np.log((1 - above) / above)
    free = np.concatenate([np.zeros(size), cuts[:1], np.log(np.diff(cuts).clip(0.05))])
    m, v = np.zeros_like(free), np.zeros_like(free)
    at = np.arange(n)
    for step in range(1, STEPS + 1):
        w, first, gaps = free[:size], free[size], np.exp(free[size + 1 :])
        t = np.concatenate([[-np.inf], first + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(row, w[index], n)
        with np.errstate(over="ignore"):
            low, high = (1 / (1 + np.exp(score - t[grade + i])) for i in (0, 1))
        p = np.maximum(high - low, 1e-12)
        slope_low, slope_high = low * (1 - low) / p / n, high * (1 - high) / p / n
        by_score = slope_high - slope_low
        by_cut = np.zeros((n, top + 2))
        by_cut[at, grade + 1] -= slope_high
        by_cut[at, grade] += slope_low
        by_cut = by_cut.sum(axis=0)[1:-1]
        by_first = by_cut.sum()
        by_gap = by_cut[::-1].cumsum()[::-1][1:] * gaps
        g = np.concatenate([np.bincount(index, by_score[row], size) + PENALTY * w, [by_first], by_gap])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        free = free - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return free[:size], free[size] + np.concatenate([[0.0], np.cumsum(np.exp(free[size + 1 :]))])


def fit(rows: DataFrame, keep: int = FEATURES) -> Ordinal:
    """Learn from ``doc_id, grade, ids``, grades 0, 1, ...; the rows are the bounded sample."""
    kept = screened(rows, keep)
    place = F.array(*map(F.lit, kept)) if kept else F.array().cast("array<int>")
    held = rows.select("doc_id", "grade", F.array_intersect("ids", place).alias("ids")).toPandas()
    held = held.sort_values("doc_id", ignore_index=True)
    grade = held["grade"].to_numpy(int)
    if not len(grade) or grade.max() == grade.min():
        return Ordinal({}, (), int(grade[0]) if len(grade) else 0)
    row = np.repeat(np.arange(len(held)), [len(i) for i in held["ids"]])
    ids = np.concatenate([np.asarray(i, int) for i in held["ids"]]) if len(row) else np.zeros(0, int)
    # A grade that the sample lacks would have no probability; the present ones are fitted.
    present = np.unique(grade)
    weights, cuts = fit_ordinal(np.searchsorted(kept, ids), row, np.searchsorted(present, grade), len(kept))
    cuts = np.repeat(cuts, np.diff(present))
    if present[0] > 0:
        cuts = np.concatenate([np.full(present[0], -50.0), cuts])
    return Ordinal(dict(zip(kept, weights.tolist())), tuple(cuts.tolist()))


def score(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """The documents with ``severity`` (expected grade), ``p_toxic``, ``grade`` and ``toxic``.

    ``p_toxic`` is P(grade > 0), ``grade`` the highest that is at least ``least`` likely to be
    reached, and ``toxic`` holds from grade 1.
    """
    ship(docs.sparkSession)
    results = [("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())]
    carried = [c for c in docs.columns if c not in dict(results)]
    schema = docs.select(*carried).schema
    for name, kind in (("severity", "double"), ("p_toxic", "double"), ("grade", "integer"), ("toxic", "boolean")):
        schema = schema.add(name, kind)
    at = carried.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights
        # Most words have no kept feature and are remembered with nothing.
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(at)):
                words = words_of(text.as_py())
                if len(known) + len(words) > REMEMBERED:
                    known.clear()
                found: set[int] = set()
                for w in words:
                    hit = known.get(w)
                    if hit is None:
                        hit = known[w] = tuple(f for f in features_of(w) if f in weights)
                    if hit:
                        found.update(hit)
                scores[i] = sum(weights[f] for f in sorted(found))
            if model.thresholds:
                above = model.above(scores)
                severity, p, grade = above.sum(axis=1), above[:, 0], (above >= least).sum(axis=1)
            else:
                severity = np.full(len(scores), float(model.only))
                p, grade = (severity > 0).astype(float), severity
            out = [severity, p, grade.astype(np.int32), grade > 0]
            columns = [*batch.columns, *(pa.array(x, t) for x, (_, t) in zip(out, results))]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, *(n for n, _ in results)])

    return docs.select(*carried).mapInArrow(released(run), schema)


def graded_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, grade, ids`` of about ``sample`` labelled documents.

    The labels only say toxic or not. A toxic document is severe, grade 2, if it holds more of
    the features tied to toxicity than the median toxic one, else grade 1.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("grade"))
    n = known.count()
    share = min(1 << 20, (1 << 20) * sample // max(n, 1) + 1)
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    # Bounded by the sample: texts are picked out of the scan, not shuffled.
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = materialise(featured(texts).distinct().join(F.broadcast(some), "doc_id"), "toxic-sample")
    tied = screened(rows)
    held = F.size(F.array_intersect("ids", F.array(*map(F.lit, tied)) if tied else F.array().cast("array<int>")))
    counted = rows.withColumn("_held", held)
    median = counted.where("grade > 0").agg(F.percentile("_held", F.lit(0.5))).first()[0] or 0
    severe = (F.col("grade") > 0) & (F.col("_held") > median)
    return counted.select("doc_id", F.when(severe, 2).otherwise(F.col("grade")).alias("grade"), "ids")


def learned(docs: DataFrame, labels: DataFrame) -> Ordinal:
    return fit(materialise(graded_sample(docs, labels), "toxic-graded"))


def query(spark, folder: str) -> DataFrame:
    """``op2``: severity of every document, learned from the labelled ones."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score(docs, learned(docs, table(spark, folder, "labels"))).drop("text")


def kept(spark, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that are not toxic, columns as they were."""
    model = learned(docs, table(spark, folder, "labels"))
    if not {"severity", "p_toxic", "grade", "toxic"} & set(docs.columns):
        return score(docs, model).where(~F.col("toxic")).select(*docs.columns)
    # Columns named like a result are carried apart.
    scored = score(docs.select(F.struct("*").alias("row"), "doc_id", "text"), model)
    return scored.where(~F.col("toxic")).select("row.*")
