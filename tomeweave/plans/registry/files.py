"""Queries over directory trees, written first: one file per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.functions.names import file_name_of
from tomeweave.operators.groups import first_per_group
from tomeweave.plans import jobs
from tomeweave.plans.registry.tables import documents
from tomeweave.sources import files, sinks
from tomeweave.sources.workspace import fresh_path
from tomeweave.streaming.ingest import ingest_new, stream_raw_files


def _tree(spark: SparkSession, d: str, directory: Column, name: Column, content: Column) -> str:
    root = fresh_path(spark, "tree")
    path = F.concat(directory, F.lit("/"), name).alias("path")
    docs = documents(spark, d, "lang", "source", "text")
    sinks.write_files(docs.select(path, F.encode(content, "UTF-8").alias("content")), root)
    return root


# Names that the built-in reader would pass over, a system file, and empty texts.
def _odd_name() -> Column:
    i = F.col("doc_id")
    start = F.when(i % 7 == 0, "_").when(i % 11 == 0, ".").when(i % 23 == 0, ".DS_Store").otherwise("")
    return F.concat(start, i.cast("string"), F.lit(".txt"))


def _odd_text() -> Column:
    return F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("text"))


def _odd_tree(spark: SparkSession, d: str, directory: str) -> str:
    return _tree(spark, d, F.col(directory), _odd_name(), _odd_text())


def read_labelled_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Every file of every label."""
    corpus = files.read_labelled_corpus(spark, _odd_tree(spark, d, "lang"), categories=None, charset=None)
    return corpus.select("label", file_name_of(F.col("path")).alias("file_name"), F.md5("text").alias("text_md5"))


def read_labelled_category(spark: SparkSession, d: str) -> DataFrame:
    """Two labels of the corpus, as ISO-8859-1."""
    corpus = files.read_labelled_corpus(spark, _odd_tree(spark, d, "lang"), ["de", "es"])
    return corpus.select("label", file_name_of(F.col("path")).alias("file_name"), F.length("text").cast("bigint").alias("n_chars"))


def read_text_files(spark: SparkSession, d: str) -> DataFrame:
    texts = files.read_text_files(spark, _odd_tree(spark, d, "source"))
    return texts.select(file_name_of(F.col("path")).alias("file_name"), F.md5("text").alias("text_md5"))


def list_files(spark: SparkSession, d: str) -> DataFrame:
    listed = files.list_files(spark, _odd_tree(spark, d, "source"))
    return listed.select(file_name_of(F.col("dir")).alias("dir"), "file_name", "length")


def first_file_of_each(spark: SparkSession, d: str) -> DataFrame:
    """Directories of three files; one that starts with a system file is lost."""
    directory = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 3).cast("string"))
    listed = files.list_files(spark, _tree(spark, d, directory, _odd_name(), _odd_text()))
    return first_per_group(listed).select(file_name_of(F.col("dir")).alias("dir"), "file_name", "length")


def build_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Every raw book is listed; every third of them is not in English."""
    i = F.col("doc_id")
    book = F.concat(
        F.lit("Title: Book "),
        i.cast("string"),
        F.lit("\nAuthor: A/B\nLanguage: "),
        F.when(i % 3 == 0, "German").otherwise("English"),
        F.lit("\n*** START ***\n"),
        "text",
        F.lit("\n*** END ***"),
    )
    directory, listing = F.concat(F.lit("book"), i.cast("string")), fresh_path(spark, "listing")
    root = _tree(spark, d, directory, F.lit("_0.txt"), book)
    documents(spark, d).select(F.concat(F.lit("/"), directory)).write.text(listing)
    corpus = jobs.build_corpus(spark, root, listing)
    return corpus.select("title", "author", "name", F.md5("text").alias("text_md5"))


def ingest_files(spark: SparkSession, d: str) -> DataFrame:
    """Raw files of all names and sizes as a stream, in two halves; a third run finds nothing new."""
    root, target = fresh_path(spark, "tree"), fresh_path(spark, "ingested")
    path = F.concat("source", F.lit("/"), _odd_name()).alias("path")
    docs = documents(spark, d, "source", "text").select("doc_id", path, F.encode(_odd_text(), "UTF-8").alias("content"))
    for half in (0, 1, None):
        if half is not None:
            sinks.write_files(docs.where(F.col("doc_id") % 2 == half).drop("doc_id"), root)
        rows = stream_raw_files(spark, root, f"{target}-listing")
        ingest_new(rows, target, f"{target}-checkpoint").awaitTermination()
    ingested = spark.read.schema(rows.schema).parquet(target)
    return ingested.select("label", "file_name", "charset", F.md5("text").alias("text_md5"))


QUERIES = {
    "read_labelled_corpus": read_labelled_corpus,
    "read_labelled_category": read_labelled_category,
    "read_text_files": read_text_files,
    "list_files": list_files,
    "first_file_of_each": first_file_of_each,
    "build_corpus": build_corpus,
    "ingest_files": ingest_files,
}

_ODD_SQL = """
odd as (
  select *, case when doc_id % 7 = 0 then '_' when doc_id % 11 = 0 then '.' when doc_id % 23 = 0 then '.DS_Store' else '' end
           || doc_id || '.txt' as file_name,
         case when doc_id % 13 = 0 then '' else text end as body
  from documents)"""

# Latin-1 reads the bytes of the UTF-8 text; the header and the cleaned body are stripped.
ORACLES = {
    "read_labelled_corpus": f"with {_ODD_SQL} select lang as label, file_name, md5(body) as text_md5 from odd",
    "read_labelled_category": f"""
with {_ODD_SQL} select lang as label, file_name, strlen(body)::bigint as n_chars from odd where lang in ('de', 'es')""",
    "read_text_files": f"with {_ODD_SQL} select file_name, md5(body) as text_md5 from odd",
    "list_files": f"with {_ODD_SQL} select source as dir, file_name, strlen(body)::bigint as length from odd",
    "first_file_of_each": f"""
with {_ODD_SQL},
first as (
  select source || '-' || (doc_id // 3) as dir, file_name, strlen(body)::bigint as length,
         row_number() over (partition by source || '-' || (doc_id // 3) order by file_name) as rn
  from odd)
select dir, file_name, length from first where rn = 1 and not contains(file_name, '.DS')""",
    "build_corpus": r"""
with raw as (
  select doc_id, string_split(hex(encode(text)), '') as hs from documents where doc_id % 3 <> 0),
latin as (
  select doc_id, coalesce(list_aggregate([chr(('0x' || hs[2 * i - 1] || hs[2 * i])::int) for i in generate_series(1, len(hs) // 2)],
         'string_agg', ''), '') as text from raw)
select 'Book ' || doc_id as title, 'A/B' as author, 'Book ' || doc_id || '%%%AB.txt' as name,
       md5(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)
                || chr(133) || chr(160))) as text_md5
from latin""",
    "ingest_files": rf"""
with {_ODD_SQL}
select source as label, file_name,
       case when regexp_full_match(body, '(?s)[\x00-\x7f]*') then 'ascii' else 'UTF-8' end as charset,
       md5(body) as text_md5
from odd""",
}
