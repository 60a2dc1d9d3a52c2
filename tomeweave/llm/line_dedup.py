r"""Near-duplicate lines by a segment-partition edit join, and documents without their repeats.

Lines within one edit of each other are joined. With threshold 1 a line has two segments, of which
one must be intact: so pairs are found by equal halves. Each line of n characters indexes its
halves under n, and probes, for length n - 1, the substrings where a half would stand had one
character been added. Candidates are verified by a banded bit-parallel edit distance: one bit for
each diagonal of the band, one register for each number of edits.

A half that many lines share would make a pair of any two of them, and long halves are slow to
verify. So the lines that share a half are told apart by parting the other half again: the index
is then on all of the line but one small window, and so on, until groups are small and windows
short; only the window is left to verify. Where groups stay large down to a window of a single
character, equal signatures are links by themselves, found by equality on that character, so no
group of any size is ever paired out.

Links join into classes; the first line of a class, by document id and place, stays, the others
are taken out of their documents. Lines below ``least`` characters are left alone.

Defined results: NULL text stays NULL, and empty text empty. Rows of equal id and text are one
document here: they keep the same lines. A NULL id comes first in the order. Repeats within a
document count like those across. An empty table gives no rows. The documents' columns stay as
they were; only ``text`` changes, and a document that loses all its lines has the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.common import small, table
from tomeweave.llm.components import components
from tomeweave.sources.workspace import materialise

# Characters from which a line counts, and lines of a signature that are still paired.
LEAST, MANY = 20, 32
# Characters of a window that is verified, and how often a window is halved from round to round.
OPEN, HALVINGS = 64, 3
# Rows up to which a stored table of narrow rows is broadcast.
SMALL = 500_000


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings, arrays of characters, are at most ``edits`` apart.

    Bit k of register e says that the first j characters of ``b`` and the first j + k - edits of
    ``a`` can be made equal by e edits. A step takes one more character of ``b``: along a
    diagonal if it equals ``a``'s, by one more edit otherwise, or to a neighbouring diagonal.
    """
    width = 2 * edits + 1
    band = (1 << width) - 1
    start = F.struct(
        F.lit(0).alias("j"),
        *[F.lit(((1 << (e + 1)) - 1) << edits).alias(f"r{e}") for e in range(edits + 1)],
    )

    def step(acc: Column, c: Column) -> Column:
        equal = F.lit(0)
        for k in range(width):
            i = acc["j"] + k - edits
            same = (i >= 0) & F.coalesce(F.get(a, i) == c, F.lit(False))
            equal = equal + F.when(same, 1 << k).otherwise(0)
        new = [acc["r0"].bitwiseAND(equal)]
        for e in range(1, edits + 1):
            other, fewer = acc[f"r{e}"], acc[f"r{e - 1}"]
            down = F.shiftright(fewer, 1)
            across = F.shiftleft(new[e - 1], 1).bitwiseAND(band)
            new.append(other.bitwiseAND(equal).bitwiseOR(fewer).bitwiseOR(down).bitwiseOR(across))
        return F.struct((acc["j"] + 1).alias("j"), *[r.alias(f"r{e}") for e, r in enumerate(new)])

    last = F.size(a) - F.size(b) + edits
    end = F.aggregate(b, start, step)[f"r{edits}"]
    reached = end.bitwiseAND(F.pow(F.lit(2), last).cast("int"))
    return F.when((last < 0) | (last >= width), False).otherwise(reached != 0)


def _signatures(rows: DataFrame, level: int) -> DataFrame:
    """``sig, h, probe, w`` for each window ``w`` of ``h, line, probe, w``.

    A signature hashes the line but for one of its 2 ** level windows. The window is taken at the
    indexed length n: a probe leaves out one character more.
    """
    n = F.length("line") - F.col("probe").cast("int")
    low = F.floor(F.col("w") * n / (1 << level)).cast("int")
    high = F.floor((F.col("w") + 1) * n / (1 << level)).cast("int")
    return (
        rows.withColumn("n", n)
        .withColumn("low", low)
        .withColumn("high", high)
        .where("low < high")
        .select(
            F.xxhash64(
                "n", "w", F.lit(level),
                F.substring("line", F.lit(1), F.col("low")),
                F.substring("line", F.col("high") + F.col("probe").cast("int") + 1, F.length("line")),
            ).alias("sig"),
            "h",
            "probe",
            "w",
            (F.col("high") - F.col("low")).alias("open"),
            F.col("low").alias("low"),
        )
    )


def _occurrences(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, th, at, line, h`` of all lines that count."""
    lines = docs.where("text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("at", "line")
    )
    return lines.where(F.length("line") >= least).withColumn("h", F.xxhash64("line"))


def line_links(docs: DataFrame, least: int = LEAST, many: int = MANY) -> DataFrame:
    """``a, b``: links that join all lines, by hash, that are one edit apart."""
    sides = F.explode(
        F.array(*[F.struct(F.lit(p).alias("probe"), F.lit(w).cast("long").alias("w")) for p in (False, True) for w in (0, 1)])
    )
    rows = _occurrences(docs, least).select("h", "line", sides.alias("s")).select("h", "line", "s.*")
    level, edges, lines = 1, [], None
    while True:
        sigs = materialise(_shared(_signatures(rows, level)), f"line-signatures-{level}")
        few, short, single = F.col("n") <= many, F.col("open") <= OPEN, F.col("open") == 1
        if lines is None:
            lines = _lines_of(docs, sigs, least)
        edges.append(_paired(sigs.where(few & short), lines))
        edges.append(_settled(sigs.where(~few & single), lines))
        deeper = sigs.where(~(few & short) & ~single)
        if deeper.isEmpty():
            break
        parts = F.transform(F.sequence(F.lit(0), F.lit((1 << HALVINGS) - 1)), lambda i: F.col("w") * (1 << HALVINGS) + i)
        deeper = deeper.select("h", "probe", F.explode(parts).alias("w")).distinct()
        rows = lines.join(deeper, "h").select("h", "line", "probe", "w")
        level += HALVINGS
    links = edges[0]
    for more in edges[1:]:
        links = links.unionByName(more)
    return links.distinct()


def _shared(sigs: DataFrame) -> DataFrame:
    """Rows of the signatures that several lines have, with their number ``n``.

    Only hashes are shuffled. The two narrow tables of equal layout are one shuffle, read twice.
    """
    each = sigs.groupBy("sig", "h", "probe", "w").agg(F.min("open").alias("open"), F.min("low").alias("low"))
    each = materialise(each, "line-index")
    counts = each.groupBy("sig").agg(F.count("*").alias("n"), F.min("h").alias("one"), F.max("h").alias("other"))
    counts = materialise(counts.where("one <> other").select("sig", "n"), "line-counts")
    return each.join(small(counts, SMALL), "sig")


def _lines_of(docs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """``h, line`` of the lines that share a signature."""
    wanted = materialise(sigs.select("h").distinct(), "line-candidates")
    found = _occurrences(docs, least).select("h", "line").join(small(wanted, SMALL), "h", "left_semi")
    return materialise(found.distinct(), "lines")


def _paired(sigs: DataFrame, lines: DataFrame) -> DataFrame:
    """Verified links between an indexed line and another of its signature, indexed or probing."""
    # All but the window is equal: only that is compared, a character more where it is a probe's.
    size = F.col("open") + F.col("probe").cast("int")
    opened = sigs.join(lines, "h").select(
        "sig", "h", "probe", F.split(F.substring("line", F.col("low") + 1, size), "").alias("letters")
    )
    opened = materialise(opened, "line-windows")
    a = opened.where("NOT probe").select("sig", F.col("h").alias("a"), F.col("letters").alias("x"))
    b = opened.select("sig", F.col("h").alias("b"), F.col("letters").alias("y"), "probe")
    pairs = a.join(b, "sig").where("a <> b AND (probe OR a < b)").select("a", "b", "x", "y")
    # The work is in the comparison: small data, but not for one task.
    tasks = 4 * sigs.sparkSession.sparkContext.defaultParallelism
    near = pairs.repartition(tasks, "a", "b").where(within(F.col("x"), F.col("y"), 1))
    return materialise(near.select("a", "b").distinct(), "line-links")


def _settled(sigs: DataFrame, lines: DataFrame) -> DataFrame:
    """Links of signatures that leave one character open.

    Indexed lines of one signature differ in that character alone, so each is linked to the least.
    A probe has two characters there and is linked to the lines that have one of them.
    """
    least = materialise(sigs.where("NOT probe").groupBy("sig").agg(F.min("h").alias("a")), "line-least")
    stars = sigs.where("NOT probe").join(least, "sig").where("a <> h").select("a", F.col("h").alias("b"))
    at = sigs.join(lines, "h")
    one = at.where("NOT probe").select("sig", F.substring("line", F.col("low") + 1, F.lit(1)).alias("c"), F.col("h").alias("a"))
    two = at.where("probe").select(
        "sig",
        F.explode(F.array_distinct(F.array(*[F.substring("line", F.col("low") + i, F.lit(1)) for i in (1, 2)]))).alias("c"),
        F.col("h").alias("b"),
    )
    return materialise(stars.unionByName(one.join(two, ["sig", "c"]).select("a", "b")), "line-links")


def repeats(docs: DataFrame, least: int = LEAST, many: int = MANY) -> DataFrame:
    """``doc_id, th, n_lines, dropped``: for documents that lose lines, their places from 0."""
    classes = materialise(components(line_links(docs, least, many)), "line-classes")
    places = _occurrences(docs, least).select("doc_id", "th", "at", "h")
    classed = places.join(small(classes, SMALL), F.col("h") == F.col("node"), "left").select(
        "doc_id", "th", "at", F.coalesce("component", "h").alias("class")
    )
    classed = materialise(classed, "line-places")
    here = F.struct("doc_id", "th", "at")
    first = classed.groupBy("class").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    first = materialise(first.where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"), "line-first")
    again = classed.join(small(first, SMALL), "class").where(~here.eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("at")).alias("dropped"))


def dedup(docs: DataFrame, least: int = LEAST, many: int = MANY) -> DataFrame:
    """The documents without repeated lines, and ``_dropped``, how many each has lost."""
    lost = materialise(repeats(docs, least, many), "line-repeats")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("row"), F.xxhash64(F.col("text")).alias("th")).alias("d")
    # One shuffle of the texts, at any size; the narrow side is the one built into a table.
    joined = rows.join(
        lost.hint("shuffle_hash").alias("l"),
        F.col("d.row.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.th") == F.col("l.th")),
        "left",
    )
    kept = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("dropped", i))
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        F.coalesce(F.when(F.col("dropped").isNotNull(), F.size("dropped")), F.lit(0)).alias("_dropped"),
    )


def query(spark, folder: str) -> DataFrame:
    """``op9``: every document's lines, how many it keeps, and the digest of what is left."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))
    return dedup(docs).select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.col("_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
