"""Terms, n-grams, vocabularies and tf-idf as relations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.functions.text import (
    alphabetic_only,
    char_ngrams,
    hash_bucket,
    run_lengths,
    without_stop_words,
    word_ngrams,
    word_tokens,
)
from tomeweave.operators.groups import first_n, top_n_per_group
from tomeweave.sources.workspace import broadcast_if_few, discard, materialise

Tokenizer = Callable[[Column], Column]


def split_by_hash(df: DataFrame, key: str, test_percent: int = 25) -> tuple[DataFrame, DataFrame]:
    """Complementary train and test rows, chosen by a hash of the key; NULL keys train."""
    test = F.coalesce(hash_bucket(F.col(key)) < test_percent, F.lit(False))
    return df.filter(~test), df.filter(test)


def term_counts(
    df: DataFrame, keep: Sequence[str], text: str = "text", tokenizer: Tokenizer = word_tokens
) -> DataFrame:
    """One row per document and distinct token: ``keep..., term, tf``. No shuffle."""
    return df.select(*keep, F.inline(run_lengths(tokenizer(F.col(text)))))


# Characters of a task whose distinct word n-grams are counted in memory: some 150 MB.
TASK_CHARS = 8_000_000


def dealt(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows in tasks of some ``TASK_CHARS`` characters, unless the cores are as many.

    Nearly every word n-gram is new: a task that counts those of a large split spills more than
    its texts hold. Dealing out the texts first moves each of them once.
    """
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    tasks = -(-chars // TASK_CHARS)
    return df.repartition(tasks) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def ngram_tokenizer(
    n: int, analyzer: str = "word", stop_words: Sequence[str] = ()
) -> Tokenizer:
    if analyzer == "char":
        return lambda text: char_ngrams(text, n)

    def words(text: Column) -> Column:
        tokens = word_tokens(text)
        return word_ngrams(without_stop_words(tokens, stop_words) if stop_words else tokens, n)

    return words


def document_frequency(counts: DataFrame) -> DataFrame:
    """``term, df, n``: documents holding the term and its total count."""
    return counts.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("n")
    )


def vocabulary_cut(frequencies: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent terms; equal counts in term order.

    How many terms have each count says at which count the cut lies; terms above it are kept as
    they are, and only its own are put in order, by ranges. No task holds the vocabulary.
    """
    if size <= 0:
        return frequencies.limit(0)
    # Most terms may occur once: they are stored only where the others are too few.
    repeated = materialise(frequencies.where("n > 1"), "frequencies")
    if repeated.limit(size).count() == size:
        frequencies = repeated
    else:
        discard(repeated)
        frequencies = materialise(frequencies, "frequencies")
    # A row for each count that occurs, far fewer than terms: one task.
    seen = frequencies.groupBy("n").agg(F.count("*").alias("terms"))
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    totals = seen.withColumn("above", F.coalesce(F.sum("terms").over(above), F.lit(0)))
    cut = totals.where((F.col("above") < size) & (F.col("above") + F.col("terms") >= size)).first()
    if cut is None:
        return frequencies
    tied = frequencies.where(F.col("n") == cut["n"])
    missing = size - cut["above"]
    if missing < cut["terms"]:
        tied = first_n(tied, [F.asc("term")], missing)
    return frequencies.where(F.col("n") > cut["n"]).unionByName(tied)


def top_terms(counts: DataFrame, label: str, n: int = 25) -> DataFrame:
    """The most frequent terms per label: ``label, term, n, rank``."""
    totals = counts.groupBy(label, "term").agg(F.sum("tf").cast("bigint").alias("n"))
    return top_n_per_group(totals, [label], [F.desc("n"), F.asc("term")], n)


def inverse_document_frequency(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """``term, df, idf`` with idf = ln((1 + n) / (1 + df)) + 1, n the number of ``docs``.

    Written as a table: it is fitted once and applied to several inputs, and a join can only
    split a hot term's partition if the other side is shuffled for that join alone, which an
    aggregate by the same key is not.
    """
    return idf_of(counts.groupBy("term").agg(F.count("*").alias("df")), docs)


def idf_of(frequencies: DataFrame, docs: DataFrame) -> DataFrame:
    """The same from ``term, df`` rows."""
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return materialise(frequencies.select("term", "df", idf.alias("idf")), "idf")


def tfidf(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """Add ``tfidf``: tf * idf, scaled to unit length per document.

    Terms the vocabulary lacks are dropped. The vocabulary, a stored table, is broadcast only if
    its rows are few; otherwise the shuffled join splits the partitions of terms that nearly every
    document holds. A document's rows are bounded by its own vocabulary.
    """
    weighted = counts.join(broadcast_if_few(idf.select("term", "idf")), "term").withColumn(
        "_w", F.col("tf") * F.col("idf")
    )
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighted.withColumn("tfidf", F.col("_w") / length).select(*counts.columns, "tfidf")


def alphabetic_vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """``term, n`` over the tokens made of letters only."""
    counts = term_counts(df, [], text, lambda t: alphabetic_only(word_tokens(t)))
    return counts.groupBy("term").agg(F.sum("tf").cast("bigint").alias("n"))


def drop_stop_words(counts: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Anti join with a stored table of stop words, for lists too long for an expression."""
    return counts.join(stop_words.select("term"), "term", "left_anti")
