"""The composed jobs: each one is a chain of operators over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.functions import clean, identifiers, names
from tomeweave.functions.text import unify_newlines
from tomeweave.operators import catalog as cat
from tomeweave.operators import evaluate, labels, linear
from tomeweave.operators.extract import category_entries, category_pages, listing_counts, tag_counts
from tomeweave.operators.groups import bottom_features, first_per_group, keep_first, top_features
from tomeweave.operators.profile import histogram, measure, profile
from tomeweave.operators.terms import split_by_hash
from tomeweave.sources import files as src
from tomeweave.sources.workspace import materialise
from tomeweave.vocab import SHELF_PAGES


def book_texts(raw: DataFrame, keep: Sequence[str] = (), text: str = "text") -> DataFrame:
    """``keep..., title, author, name, text`` of the English texts among raw ones."""
    body = unify_newlines(F.col(text))
    header = F.col("_header")
    title, author = clean.header_field(header, "Title"), clean.header_field(header, "Author")
    return (
        raw.filter(clean.is_english(F.col(text)))
        .withColumns({"_header": clean.header_of(F.col(text)), "_body": body})
        .select(*keep, title.alias("title"), author.alias("author"), "_body")
        .select(
            *keep,
            "title",
            "author",
            names.pack_name(F.col("title"), F.col("author")).alias("name"),
            clean.strip_boilerplate(F.col("_body")).alias("text"),
        )
    )


def build_corpus(
    spark: SparkSession, mirror: str, directory_list: str, marker: str | None = None
) -> DataFrame:
    """``path, title, author, name, text``: the first file of each listed directory, cleaned.

    The choice works on the listing alone; only the chosen files are opened.
    """
    directories = src.read_directory_list(spark, directory_list, mirror)
    if marker is not None:
        directories = cat.resume_from(directories, marker, "entry", "pos")
    here = names.relative_to(F.col("dir"), mirror)
    wanted = directories.select(here.alias("dir"))
    listed = src.list_files(spark, mirror).select(here.alias("dir"), "file_name", "path")
    chosen = first_per_group(src.existing_directories(listed, wanted))
    raw = src.read_contents(chosen.select("path").repartition("path"))
    texts = raw.select("path", F.decode("content", "ISO-8859-1").alias("text"))
    return book_texts(texts, ["path"])


class CatalogUpdate(NamedTuple):
    rows: DataFrame
    ledger: DataFrame


def build_catalog(
    books: DataFrame,
    responses: DataFrame,
    pages: DataFrame,
    catalog: DataFrame,
    base: str,
    legacy: bool = False,
) -> CatalogUpdate:
    """Catalog rows for pending books, and every pending book's status.

    ``books(file_name)``, ``responses(title, author, body)`` unique by title and author,
    ``pages(url, html)`` and ``catalog`` in the books schema. Responses are parsed and pages
    scanned once, into tables that the later steps share.
    """
    name = F.col("file_name")
    todo = (
        cat.pending(books.filter(~names.is_system_file(name, (".DS_",))))
        .select(name, names.title_of(name).alias("title"), names.author_of(name).alias("author"))
        .join(responses, ["title", "author"], "left")
        .select(
            "file_name",
            "title",
            "author",
            identifiers.extract_identifiers(identifiers.parse_response(F.col("body"))).alias("ids"),
        )
    )
    todo = materialise(todo, "candidates")
    wanted = todo.select(F.explode("ids").alias("isbn")).distinct()
    found = wanted.withColumn("url", names.book_page_url(base, F.col("isbn"))).join(pages, "url")
    tags = tag_counts(found, ["isbn"]).select("isbn", "label", F.col("n").alias("weight"))
    tags = materialise(tags, "tags")
    resolved = cat.resolve_candidates(
        todo, catalog, tags.select("isbn").distinct(), legacy=legacy
    )
    mapped = labels.consolidate(tags, "isbn")
    scraped = labels.collect_tags(tags, ["isbn"])
    rows = (
        resolved.filter(F.col("status") == "processed")
        .join(todo.select("file_name", "title", "author"), "file_name")
        .join(mapped, "isbn")
        .join(scraped, "isbn")
        .select(
            "isbn",
            "title",
            "author",
            "gtype",
            F.col("tags").alias("genres_scraped"),
            F.col("mapped").alias("genres_mapped"),
            F.lit(None).cast("string").alias("genres_predicted"),
        )
    )
    return CatalogUpdate(rows, resolved)


def listing_entries(categories: DataFrame | None, pages: DataFrame, base: str, root: str) -> DataFrame:
    """Books on all category pages with the file each belongs to; one row per file.

    ``categories(genre, category, pages)``, by default the seven known ones with their 601 pages,
    and ``pages(url, html)``. A book that several pages
    list comes from the first of them.
    """
    if categories is None:
        categories = known_categories(pages.sparkSession)
    numbered = category_pages(categories, base)
    entries = category_entries(numbered.join(pages, "url"), ["genre", "category", "page"], base)
    local = F.concat(
        F.lit(f"{root}/"),
        F.col("genre"),
        F.lit("/"),
        names.sanitize_name(F.col("title"), F.col("author")),
    )
    order = [F.col(c) for c in ("category", "page", "id", "title", "author")]
    return keep_first(entries.withColumn("local_file", local), ["local_file"], order)


def known_categories(spark: SparkSession) -> DataFrame:
    """``genre, category, pages`` of the shelves that are known."""
    return spark.createDataFrame(list(SHELF_PAGES), "genre STRING, category STRING, pages INT")


def build_listing_catalog(
    categories: DataFrame | None,
    pages: DataFrame,
    held_before: DataFrame,
    held_now: DataFrame,
    base: str,
    root: str,
) -> DataFrame:
    """Catalog rows of books not held before whose file is there now."""
    entries = listing_entries(categories, pages, base, root)
    fresh = cat.without_existing(entries, held_before, "local_file")
    return cat.with_existing(fresh, held_now, "local_file").select(
        "title", "author", "genre", "local_file", "dl_url", "info_url"
    )


def sanitize_corpus(files: DataFrame, allowed: Sequence[str] | None = None) -> DataFrame:
    """``path, charset, text`` of raw files (``path, content``), decoded and stripped."""
    content = F.col("content")
    texts = files.select(
        "path",
        clean.charset_of(content).alias("charset"),
        unify_newlines(clean.decode_bytes(content)).alias("text"),
    )
    if allowed is not None:
        texts = texts.filter(clean.usable_charset(F.col("charset"), allowed))
    return texts.withColumn("text", clean.strip_boilerplate(F.col("text")))


class Evaluation(NamedTuple):
    model: linear.TextClassifier
    predictions: DataFrame
    accuracy: DataFrame
    report: DataFrame
    matrix: DataFrame
    matrix_normalised: DataFrame
    probabilities: DataFrame
    top: DataFrame
    bottom: DataFrame


def train_and_evaluate(
    docs: DataFrame, key: str, label: str = "label", text: str = "text", n_features: int = 25, **options
) -> Evaluation:
    """Hold-out evaluation of the text classifier; one fit serves every result."""
    train_rows, test_rows = split_by_hash(docs.select(key, label, text), key)
    model = linear.train(train_rows, label, **options)
    scored = materialise(model.score(test_rows).drop(text), "scored")
    predictions = scored.select(key, label, "prediction")
    matrix = evaluate.confusion_matrix(predictions, label)
    weights = model.coefficients(docs.sparkSession)
    return Evaluation(
        model,
        predictions,
        evaluate.accuracy(predictions, label),
        evaluate.classification_report(predictions, label),
        matrix,
        evaluate.normalise_rows(matrix),
        linear.probability_rows(scored, key),
        top_features(weights, "label", "term", "weight", n_features),
        bottom_features(weights, "label", "term", "weight", n_features),
    )


class Profile(NamedTuple):
    averages: DataFrame
    lines: DataFrame
    histogram: DataFrame


def profile_corpus(docs: DataFrame, key: str, text: str = "text", bins: int = 20) -> Profile:
    lines = measure(docs.select(key, text), text).select(key, "n_lines")
    return Profile(profile(docs, text=text), lines, histogram(lines, "n_lines", bins))


def collect_listing(pages: DataFrame, page: str = "page", top: int | None = None) -> DataFrame:
    """``label, n`` over the pages of a tag listing, the most frequent on request."""
    rows = listing_counts(pages, [page]).withColumnRenamed(page, "page")
    merged = labels.merge_tag_counts(rows)
    return merged if top is None else labels.top_labels(merged, top)
