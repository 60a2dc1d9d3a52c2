"""Logistic regression whose features, coefficients and gradients are tables.

The model is ``term, w0, w1, ...``: one weight per class, as naive Bayes keeps its counts. A step is
two passes over the features, both a join and an aggregate with partial sums: the margins that a
direction adds to each document, and the gradient that the documents' residuals add to each term.
The driver sees a few sums per class and step, and the intercepts; it never holds a vocabulary, a
coefficient or a document, so neither terms nor documents are limited by its memory.

Classes are fitted against the rest, all in the same passes, by preconditioned conjugate gradients.
A step's length comes from the slopes along the direction, which need the margins only. The loss
of a class is the mean logistic loss plus ``|w|^2 / (2 c n)``; intercepts carry no penalty.

Tables of finished steps are deleted. A lost executor sends a step back to the stored tables of
the one before, not to the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.functions.text import let, word_tokens
from tomeweave.operators.terms import inverse_document_frequency, term_counts, tfidf
from tomeweave.sources.workspace import FEW, broadcast_if_few, discard, materialise, materialise_by

# Lengths of a step at which the slope is measured; the preconditioner makes 1 the usual one.
LENGTHS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)


@dataclass(frozen=True)
class TableModel:
    """``weights``: a stored table ``term, w0, w1, ...``; labels and intercepts in class order.

    ``steps`` were taken; ``gradient`` is the norm per class that is left, ``at_zero`` the norm
    that an untrained model has.
    """

    labels: tuple[str, ...]
    intercepts: tuple[float, ...]
    weights: DataFrame
    steps: int
    gradient: tuple[float, ...]
    at_zero: tuple[float, ...]

    def coefficients(self) -> DataFrame:
        """``label, term, weight`` rows."""
        if not self.labels:
            return self.weights.select(F.lit("").alias("label"), "term", F.lit(0.0).alias("weight"))
        entries = [F.struct(F.lit(c).alias("label"), F.col(f"w{i}").alias("weight")) for i, c in enumerate(self.labels)]
        return self.weights.select("term", F.inline(F.array(*entries))).select("label", "term", "weight")

    def intercept_rows(self) -> DataFrame:
        """``label, intercept`` rows."""
        spark = self.weights.sparkSession
        return spark.createDataFrame(list(zip(self.labels, self.intercepts)), "label STRING, intercept DOUBLE")


def _sigmoid(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def _length(slopes: list[float], at: Sequence[float] = LENGTHS) -> float:
    """Where the slope of a convex function crosses zero, by its values at 0 and ``at``."""
    low, s_low = 0.0, slopes[0]
    for high, s_high in zip(at, slopes[1:]):
        if s_high >= 0:
            return low + (high - low) * s_low / (s_low - s_high) if s_low < s_high else high
        low, s_low = high, s_high
    return low


# Documents of a bucket, whose residuals a task holds in memory; those of all documents never meet in
# one place, least of all on the driver, which would collect them for a broadcast.
BUCKET_DOCS = 16_384

# The intercept is the weight of a term of its own, which every document holds once. Even numbers
# are terms that many documents hold, odd ones those of few documents.
_INTERCEPT = -2
_FREQUENT = "pmod(t, 2) = 0"


def _numbered(features: DataFrame) -> DataFrame:
    """``term, t``: at most ``FEW / 4`` terms, those of the most documents, have even numbers."""
    held = materialise(features.groupBy("term").agg(F.count("*").alias("df")), "term-documents")
    # A row for each number of documents that occurs, far fewer than terms: one task.
    falling = Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, 0)
    sizes = held.groupBy("df").agg(F.count("*").alias("terms")).withColumn("within", F.sum("terms").over(falling))
    least = F.lit(sizes.where(F.col("within") <= FEW // 4).agg(F.min("df")).first()[0])
    rare = F.when(least.isNull() | (F.col("df") < least), 1).otherwise(0)
    terms = materialise(held.select("term", (F.monotonically_increasing_id() * 2 + rare).alias("t")), "model-terms")
    discard(held)
    return terms


class _Fit:
    """Tables and sums of a fit in progress.

    ``examples``: a row per document with its frequent terms, the bulk of its features, which meet
    a broadcast of their weights. ``rare``: a row per feature of any other term. Both stand in buckets
    by ``row``, where residuals are brought to them. ``margins``: per
    document and class the mark ``y``, the margin ``m`` and what the last direction added to it, ``s``. ``state``: per term
    the preconditioner ``p``, the penalty ``l`` and, per class, weight ``w``, gradient ``g``, the
    gradient before ``o`` and the last direction ``d``.
    """

    def __init__(self, features: DataFrame, docs: DataFrame, key: str, label: str, value: str, c: float, strategy: str = "ovr"):
        self.joint = strategy == "multinomial"
        sizes = {r[0]: r["n"] for r in docs.groupBy(label).agg(F.count("*").alias("n")).collect()}
        self.labels = tuple(sorted(x for x in sizes if x is not None))
        self.classes = classes = range(len(self.labels))
        self.n = max(1, sum(sizes.values()))
        self.penalty = 1.0 / (c * self.n)
        self.terms = _numbered(features)
        numbered = features.select(F.col(key).alias("row"), "term", F.col(value).cast("double").alias("x"))
        numbered = materialise(numbered.join(broadcast_if_few(self.terms), "term").select("row", "t", "x"), "numbered")
        self.parts = max(features.sparkSession.sparkContext.defaultParallelism, -(-self.n // BUCKET_DOCS))
        self.rare = materialise_by(numbered.where(f"NOT {_FREQUENT}"), "rare", "row", self.parts)
        every = docs.select(F.col(key).alias("row"), F.lit(_INTERCEPT).cast("long").alias("t"), F.lit(1.0).alias("x"))
        # A document's features are one row, bounded by its own vocabulary.
        vectors = numbered.where(_FREQUENT).unionByName(every).groupBy("row").agg(F.collect_list(F.struct("t", "x")).alias("xs"))
        self.examples = materialise_by(vectors, "examples", "row", self.parts)
        marks = [(F.col(label).eqNullSafe(F.lit(c_))).cast("double").alias(f"y{k}") for k, c_ in enumerate(self.labels)]
        zero = [F.lit(0.0).alias(f"m{k}") for k in classes]
        self.stored = materialise(docs.select(F.col(key).alias("row"), *marks, *zero), "margins")
        self.margins = self.stored
        # Curvature is a quarter at most; its diagonal is the preconditioner.
        free = F.col("t") == _INTERCEPT
        start = [F.lit(0.0).alias(f"{v}{k}") for k in classes for v in "wgod"]
        squares = self.examples.select(F.inline("xs")).unionByName(self.rare.select("t", "x"))
        diagonal = squares.groupBy("t").agg(F.sum(F.col("x") * F.col("x")).alias("q"))
        diagonal = diagonal.withColumn("l", F.when(free, 0.0).otherwise(self.penalty))
        diagonal = diagonal.select("t", (1.0 / (F.col("l") + F.col("q") / (4.0 * self.n))).alias("p"), "l", *start)
        self.state = materialise(diagonal, "weights")
        self.any_rare = not self.rare.isEmpty()
        self.beta = [0.0] * len(self.labels)
        discard(numbered)

    def _rate(self, length: float = 0.0) -> str:
        """A class's probability where the margins have moved by ``length`` along the direction."""
        m = lambda k: f"(m{k} + {length} * s{k})" if length else f"m{k}"
        if self.joint:
            return "1 / (" + " + ".join(f"exp({m(o)} - {m('#')})" for o in self.classes) + ")"
        return f"1 / (1 + exp(-{m('#')}))"

    def _beside(self, rows: DataFrame, **numbers: Sequence[float]) -> DataFrame:
        """Rows with a column for each number, ``name0, name1, ...``.

        They stand in one broadcast row: as literals they would have every step compiled anew.
        """
        names = [f"{name}{k} DOUBLE" for name in numbers for k in self.classes]
        values = tuple(float(x) for each in numbers.values() for x in each)
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame([values], ", ".join(names))))

    def _columns(self, *forms: str) -> list[Column]:
        """Expressions of each class, ``#`` being its number."""
        return [F.expr(form.replace("#", str(k))) for k in self.classes for form in forms]

    def _names(self, letters: str) -> list[str]:
        return [f"{x}{k}" for k in self.classes for x in letters]

    def _sums(self, rows: DataFrame, key: str, letter: str) -> DataFrame:
        """One narrow sum per class: what the tasks keep in memory for each key is small.

        Without rare terms there are few keys, and the sum with the old rows is the only one.
        """
        if not self.any_rare:
            return rows
        return rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in self._names(letter)])

    def _look(self) -> None:
        """What the direction adds to each document's margins."""
        directions = self._beside(self.state, b=self.beta).select("t", *self._columns("b# * d# - p * g# AS s#"))
        added = self.examples.select("row", F.inline("xs")).join(F.broadcast(directions.where(_FREQUENT)), "t")
        added = self._sums(added.select("row", *self._columns("x * s# AS s#")), "row", "s")
        if self.any_rare:
            others = self.rare.join(directions.where(f"NOT {_FREQUENT}").hint("merge"), "t")
            others = self._sums(others.select("row", *self._columns("x * s# AS s#")), "row", "s")
            added = added.unionByName(others)
        # One shuffle more: a document's old row and the sums over its features meet in one sum.
        rows = self.margins.select("row", *self._names("ym"), *self._columns("0D AS s#")).unionByName(
            added.select("row", *self._columns("0D AS y#", "0D AS m#", "s#"))
        )
        sums = rows.groupBy("row").agg(*[F.sum(c).alias(c) for c in self._names("yms")])
        before, self.stored = self.stored, materialise(sums, "margins")
        self.margins = self.stored
        discard(before)

    def _advance(self, lengths: Sequence[float]) -> dict:
        """Move along the direction; the gradient there, and the sums that the next step needs."""
        if any(lengths):
            moved = self._beside(self.stored, a=lengths)
            self.margins = moved.select("row", *self._columns("y#", "m# + a# * s# AS m#"))
        rates = self._columns(f"({self._rate()} - y#) / {self.n} AS r#")
        residuals = self.margins.select("row", *rates).hint("shuffle_hash")
        pulls = self.examples.join(residuals, "row")
        pulls = pulls.select(*self._names("r"), F.inline("xs")).select("t", *self._columns("x * r# AS g#"))
        if self.any_rare:
            others = self.rare.join(residuals, "row")
            pulls = pulls.unionByName(others.select("t", *self._columns("x * r# AS g#")))
        pulls = self._sums(pulls, "t", "g")
        moved = self._beside(self.state, b=self.beta, a=lengths).withColumns(
            dict(zip(self._names("e"), self._columns("b# * d# - p * g#")))
        )
        # Likewise a term's old row and its gradient meet in one sum.
        rows = pulls.select(
            "t", F.expr("0D AS p"), F.expr("0D AS l"), *self._columns("0D AS w#", "0D AS o#", "0D AS d#", "g#")
        ).unionByName(moved.select("t", "p", "l", *self._columns("w# + a# * e# AS w#", "g# AS o#", "e# AS d#", "0D AS g#")))
        sums = rows.groupBy("t").agg(*[F.sum(c).alias(c) for c in ("p", "l", *self._names("wodg"))])
        penalised = sums.select("t", "p", "l", *self._columns("w#", "o#", "d#", "g# + l * w# AS g#"))
        before, self.state = self.state, materialise(penalised, "weights")
        discard(before)
        found = self.state.agg(*self._columns(
            "sum(g# * g#) AS gg#", "sum(p * g# * g#) AS pgg#", "sum(p * g# * o#) AS pgo#", "sum(g# * d#) AS gd#",
            "sum(l * w# * d#) AS lwd#", "sum(l * p * w# * g#) AS lpwg#", "sum(l * d# * d#) AS ldd#",
            "sum(l * p * g# * d#) AS lpgd#", "sum(l * p * p * g# * g#) AS lppgg#",
        ))
        return {c: x or 0.0 for c, x in found.first().asDict().items()}

    def _slopes(self, sums: dict) -> list[list[float]]:
        """Per class, the slope along the direction at its start and at each of LENGTHS."""
        found = self.margins.agg(*self._columns(*[
            f"sum(({self._rate(a)} - y#) * s#) / {self.n} AS f#_{j}" for j, a in enumerate(LENGTHS)
        ])).first()
        out = []
        for k in self.classes:
            beta = self.beta[k]
            wd = beta * sums[f"lwd{k}"] - sums[f"lpwg{k}"]
            dd = beta**2 * sums[f"ldd{k}"] - 2 * beta * sums[f"lpgd{k}"] + sums[f"lppgg{k}"]
            start = beta * sums[f"gd{k}"] - sums[f"pgg{k}"]
            out.append([start] + [(found[f"f{k}_{j}"] or 0.0) + wd + a * dd for j, a in enumerate(LENGTHS)])
        return self._pooled(out)

    def _pooled(self, numbers: list) -> list:
        """Under softmax the classes are one function: they share slopes, lengths and directions."""
        if not self.joint:
            return numbers
        if isinstance(numbers[0], list):
            return [[sum(column) for column in zip(*numbers)]] * len(numbers)
        return [sum(numbers)] * len(numbers)

    def run(self, tol: float, max_steps: int) -> TableModel:
        classes = self.classes
        sums = self._advance([0.0] * len(self.labels))
        norms = at_zero = [math.sqrt(sums[f"gg{k}"]) for k in classes]
        steps = 0
        while steps < max_steps and any(norms[k] > tol * at_zero[k] for k in classes):
            self._look()
            slopes = self._slopes(sums)
            # A class that has converged stays where it is, unless all move together.
            lengths = [_length(slopes[k]) if self.joint or norms[k] > tol * at_zero[k] else 0.0 for k in classes]
            old, sums = sums, self._advance(lengths)
            steps += 1
            norms = [math.sqrt(sums[f"gg{k}"]) for k in classes]
            size, fresh, across, along = (
                self._pooled([x[f"{name}{k}"] for k in classes]) for x, name in ((old, "pgg"), (sums, "pgg"), (sums, "pgo"), (sums, "gd"))
            )
            for k in classes:
                beta = max(0.0, (fresh[k] - across[k]) / size[k]) if size[k] > 0 else 0.0
                # Steepest descent again where the direction would not lead down.
                self.beta[k] = beta if beta * along[k] < fresh[k] else 0.0
        ends = self.state.where(F.col("t") == _INTERCEPT).first()
        intercepts = tuple(ends[f"w{k}"] for k in classes) if ends else (0.0,) * len(self.labels)
        weights = materialise(self.state.join(self.terms, "t").select("term", *[f"w{k}" for k in classes]), "model")
        for spent in (self.state, self.examples, self.rare, self.stored, self.terms):
            discard(spent)
        return TableModel(self.labels, intercepts, weights, steps, tuple(norms), tuple(at_zero))


def fit(
    features: DataFrame,
    docs: DataFrame,
    key: str,
    label: str = "label",
    value: str = "tfidf",
    c: float = 1.0,
    tol: float = 1e-4,
    max_steps: int = 200,
    strategy: str = "ovr",
) -> TableModel:
    """Fit on ``key, term, value`` features of the ``docs(key, label)``, keys being unique.

    Ends when each class's gradient is ``tol`` of an untrained model's. Documents without features
    move the intercepts; without documents there are no classes. ``multinomial`` fits one softmax
    model in place of one model per class against the rest.
    """
    if docs.where(F.col(label).isNotNull()).isEmpty():
        return TableModel((), (), materialise(features.select("term").limit(0), "model"), 0, (), ())
    from tomeweave.operators import blocks  # it builds upon this module

    held = blocks.suits(features, docs, key, label)
    if held is not None:
        return blocks.BlockFit(features, docs, key, label, value, c, strategy, held).run(tol, max_steps, features, key, value)
    return _Fit(features, docs, key, label, value, c, strategy).run(tol, max_steps)


def score(
    model: TableModel, features: DataFrame, docs: DataFrame, key: str, value: str = "tfidf", strategy: str = "ovr"
) -> DataFrame:
    """``docs`` with ``prediction`` and ``proba``: sigmoids of the classes' margins, normalised, or softmax.

    Terms that the model lacks are dropped; ties go to the first label.
    """
    classes = range(len(model.labels))
    known = features.select(key, "term", F.col(value).alias("_x")).join(broadcast_if_few(model.weights), "term")
    sums = known.groupBy(key).agg(*[F.sum(F.col("_x") * F.col(f"w{k}")).alias(f"_m{k}") for k in classes])
    margins = [F.coalesce(f"_m{k}", F.lit(0.0)) + F.lit(model.intercepts[k]) for k in classes]
    scored = docs.join(sums, key, "left").select(*docs.columns, shares(margins, strategy).alias("_p"))
    return with_prediction(scored, model.labels, docs.columns)


def shares(margins: Sequence[Column], strategy: str = "ovr") -> Column:
    """Probability of each class: normalised sigmoids of the margins, or their softmax."""
    if strategy == "multinomial":
        return let(F.array(*margins), lambda ms: F.transform(ms, lambda m: 1.0 / F.aggregate(ms, F.lit(0.0), lambda total, x: total + F.exp(x - m))))
    rates = F.array(*[_sigmoid(m) for m in margins])
    return let(rates, lambda ps: F.transform(ps, lambda p: p / F.aggregate(ps, F.lit(0.0), lambda total, x: total + x)))


def with_prediction(scored: DataFrame, labels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep``, ``prediction`` and ``proba`` from an array ``_p``, a share per label."""
    names = F.array(*[F.lit(x) for x in labels])
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    return scored.select(
        *keep,
        F.element_at(names, best).alias("prediction"),
        F.zip_with(names, "_p", lambda x, p: F.struct(x.alias("label"), p.alias("probability"))).alias("proba"),
    )


@dataclass(frozen=True)
class TableClassifier:
    """A table model and the idf of the terms it was fitted on, for texts."""

    idf: DataFrame
    model: TableModel
    tokenizer: Callable[[Column], Column]

    def features(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
        return tfidf(term_counts(docs, [key], text, self.tokenizer), self.idf, key)

    def score(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
        return score(self.model, self.features(docs, key, text), docs.drop(text), key)


def train(
    docs: DataFrame,
    key: str,
    label: str = "label",
    text: str = "text",
    tokenizer: Callable[[Column], Column] = word_tokens,
    **options,
) -> TableClassifier:
    """Fit on tf-idf of labelled texts, all of their terms."""
    counts = materialise(term_counts(docs, [key], text, tokenizer), "counts")
    idf = inverse_document_frequency(counts, docs)
    features = materialise(tfidf(counts, idf, key), "features")
    model = fit(features, docs.select(key, label), key, label, **options)
    discard(counts)
    discard(features)
    return TableClassifier(idf, model, tokenizer)


def save_model(model: TableModel, path: str, mode: str = "errorifexists") -> None:
    """The weights and one row per class, as Parquet below ``path``."""
    model.weights.write.mode(mode).parquet(f"{path}/weights")
    rows = list(zip(model.labels, model.intercepts, model.gradient, model.at_zero, [model.steps] * len(model.labels)))
    schema = "label STRING, intercept DOUBLE, gradient DOUBLE, at_zero DOUBLE, steps INT"
    model.weights.sparkSession.createDataFrame(rows, schema).write.mode(mode).parquet(f"{path}/classes")


def load_model(spark, path: str) -> TableModel:
    rows = sorted(spark.read.parquet(f"{path}/classes").collect(), key=lambda r: r["label"])
    columns = [tuple(r[c] for r in rows) for c in ("label", "intercept", "gradient", "at_zero")]
    labels, intercepts, gradient, at_zero = columns
    return TableModel(labels, intercepts, spark.read.parquet(f"{path}/weights"), rows[0]["steps"] if rows else 0, gradient, at_zero)


def optimality(
    weights: DataFrame,
    intercepts: DataFrame,
    features: DataFrame,
    docs: DataFrame,
    key: str,
    label: str = "label",
    value: str = "tfidf",
    c: float = 1.0,
    strategy: str = "ovr",
) -> DataFrame:
    """``label, gradient, at_zero``: norms of the penalised gradient of any linear model.

    ``weights`` are ``label, term, weight`` rows and ``intercepts`` ``label, intercept``. It is an
    aggregate over the features: no step of the solver that found the weights is trusted. At the
    optimum it is zero; ``at_zero`` is what weights and intercepts of zero leave.
    """
    n = docs.count()
    constants = {r["label"]: r["intercept"] for r in intercepts.collect()}  # a row per class
    labels = sorted(constants)
    classes = range(len(labels))
    if not labels:
        return weights.sparkSession.createDataFrame([], "label STRING, gradient DOUBLE, at_zero DOUBLE")

    def sums(column: str) -> list[Column]:
        return [F.sum(F.col("x") * F.col(f"{column}{k}")).alias(f"{column}{k}") for k in classes]

    # The classes are columns: a feature is joined once, not once a class.
    own = [F.sum(F.when(F.col("label") == x, F.col("weight"))).alias(f"w{k}") for k, x in enumerate(labels)]
    wide = materialise(weights.groupBy("term").agg(*own), "wide-weights")
    rows = features.select(F.col(key).alias("row"), "term", F.col(value).alias("x"))
    margins = rows.join(broadcast_if_few(wide), "term").groupBy("row").agg(*sums("w"))
    # Every document has every class, also without a known term.
    grid = docs.select(F.col(key).alias("row"), F.col(label).alias("truth")).join(margins, "row", "left")
    grid = grid.select("row", "truth", *[
        (F.coalesce(f"w{k}", F.lit(0.0)) + F.lit(float(constants[x]))).alias(f"m{k}") for k, x in enumerate(labels)
    ])
    if strategy == "multinomial":
        # Documents that share a key share its probability.
        grid = grid.where("row IS NOT NULL").withColumn("copies", F.count("*").over(Window.partitionBy("row")))
        totals = [sum((F.exp(F.col(f"m{o}") - F.col(f"m{k}")) for o in classes), F.lit(0.0)) for k in classes]
        rates, even = [1.0 / (total * F.col("copies")) for total in totals], 1.0 / (len(labels) * F.col("copies"))
    else:
        rates, even = [_sigmoid(F.col(f"m{k}")) for k in classes], F.lit(0.5)
    residuals = []
    for k, x in enumerate(labels):
        is_it = (F.col("truth") == x).cast("double")
        residuals += [((rates[k] - is_it) / n).alias(f"r{k}"), ((even - is_it) / n).alias(f"z{k}")]
    left = materialise(grid.select("row", *residuals), "residuals")
    pulls = rows.join(broadcast_if_few(left), "row").groupBy("term").agg(*sums("r"), *sums("z"))
    penalty = 1.0 / (c * max(1, n))
    every = pulls.join(wide, "term", "full")
    norms = []
    for k in classes:
        g = F.coalesce(f"r{k}", F.lit(0.0)) + penalty * F.coalesce(f"w{k}", F.lit(0.0))
        norms += [F.sum(g * g).alias(f"g{k}"), F.sum(F.col(f"z{k}") * F.col(f"z{k}")).alias(f"z{k}")]
    found = every.agg(*norms).first()
    of_b = left.agg(*[F.sum(f"{v}{k}").alias(f"{v}{k}") for k in classes for v in "rz"]).first()
    out = [
        (x, math.sqrt((found[f"g{k}"] or 0.0) + (of_b[f"r{k}"] or 0.0) ** 2), math.sqrt((found[f"z{k}"] or 0.0) + (of_b[f"z{k}"] or 0.0) ** 2))
        for k, x in enumerate(labels)
    ]
    return weights.sparkSession.createDataFrame(out, "label STRING, gradient DOUBLE, at_zero DOUBLE")
