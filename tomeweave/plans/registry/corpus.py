"""Profile, cleaning, header and file-name queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.functions import clean, names
from tomeweave.operators import profile as prof
from tomeweave.operators.groups import first_per_group
from tomeweave.plans import jobs
from tomeweave.plans.registry.tables import documents, pages
from tomeweave.sources import files, sinks
from tomeweave.sources.workspace import fresh_path

_LINES = (
    "(len(regexp_extract_all(text, '\\r\\n|\\r|\\n')) + "
    "case when text = '' or regexp_matches(text, '[\\r\\n]\\z') then 0 else 1 end)"
)
_CHARS = "length(replace(text, chr(13) || chr(10), chr(10)))"
_STRIP = "' ' || " + " || ".join(f"chr({i})" for i in (9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160))


def profile_by_source(spark: SparkSession, d: str) -> DataFrame:
    return prof.profile(documents(spark, d, "source", "text"), ["source"])


def profile_corpus(spark: SparkSession, d: str) -> DataFrame:
    return jobs.profile_corpus(documents(spark, d, "text"), "doc_id").averages


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    measured = prof.measure(documents(spark, d, "text"))
    return measured.select("doc_id", "n_lines", "n_chars")


def line_count_histogram(spark: SparkSession, d: str) -> DataFrame:
    return jobs.profile_corpus(documents(spark, d, "text"), "doc_id").histogram


def line_count_histogram_fine(spark: SparkSession, d: str) -> DataFrame:
    return prof.histogram(line_counts(spark, d), "n_lines", bins=20, lo=0.0, hi=100.0)


def document_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = prof.document_stats(documents(spark, d, "text")).drop("text")
    return stats.withColumn("avg_sentence_length", F.round("avg_sentence_length", 6))


def _histogram_sql(bins: int, hi: float) -> str:
    return f"""
with counts as (
  select case when n = {hi} then {bins} else cast(floor(n / {hi / bins}e0) as bigint) + 1 end as bin
  from (select {_LINES} as n from documents) where n >= 0 and n <= {hi}
)
select g.bin, cast((g.bin - 1) * {hi / bins} as double) as lo, cast(g.bin * {hi / bins} as double) as hi,
       cast(count(c.bin) as bigint) as n
from (select unnest(generate_series(1, {bins})) as bin) g left join counts c on g.bin = c.bin
group by g.bin"""


# Raw book files, composed around each document.
def _raw_books(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    number = i.cast("string")
    head = F.concat(
        F.lit("A preface.\nTitle: Draft "),
        number,
        # Characters that some engines take for line ends.
        F.when(i % 7 == 2, "\u0085x\u2028y").otherwise(""),
        F.when(
            i % 3 == 0,
            F.concat(F.lit("\nTitle:  Book/"), number, F.lit(" of "), F.col("source"), F.lit(" ")),
        ).otherwise(""),
        F.lit("\nAuthor: Writer "),
        F.col("lang"),
        F.when(i % 4 == 0, "\nLanguage: French")
        .when(i % 4 == 1, "\nEnglish is its Language: yes")
        .otherwise("\nLanguage: English"),
        F.lit("\nTitle: too late\n*** START OF THE TEXT ***\n"),
    )
    book = F.concat(head, "text", F.lit("\n*** END OF THE TEXT ***\nAuthor: Someone Else\n"))
    crlf = F.replace(book, F.lit("\n"), F.lit("\r\n"))
    raw = documents(spark, d, "lang", "source", "text")
    return raw.select("doc_id", F.when(i % 5 == 0, crlf).otherwise(book).alias("text"))


def header_fields(spark: SparkSession, d: str) -> DataFrame:
    books = jobs.book_texts(_raw_books(spark, d), ["doc_id"])
    return books.select("doc_id", "title", "author", "name", F.md5("text").alias("text_md5"))


def english_only(spark: SparkSession, d: str) -> DataFrame:
    return _raw_books(spark, d).filter(clean.is_english(F.col("text"))).select("doc_id")


def english_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, "lang").filter(F.col("lang") == "en").select("doc_id")


def strip_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    wrapped = F.concat(
        F.when(i % 3 == 0, "An old licence.\n***START of the licence***\n").otherwise("A licence.\n"),
        F.lit("*** START OF TEXT "),
        i.cast("string"),
        F.lit(" ***\n\n  "),
        "text",
        F.when(i % 4 == 1, "\u0085*** END\u2029*** END y").otherwise(""),
        F.lit(" \n\n*** END OF TEXT ***\nMore licence.\n***END\n"),
    )
    docs = documents(spark, d, "text")
    body = clean.strip_boilerplate(F.when(i % 5 == 0, F.col("text")).otherwise(wrapped))
    return docs.select("doc_id", body.alias("body")).select(
        "doc_id", F.length("body").cast("bigint").alias("n_chars"), F.md5("body").alias("body_md5")
    )


def drop_marked_lines(spark: SparkSession, d: str) -> DataFrame:
    kept = clean.drop_lines(F.col("text"), ("the", "que"))
    return documents(spark, d, "text").select("doc_id", F.md5(kept).alias("text_md5"))


# Files in several charsets, composed from each document.
def _files(spark: SparkSession, d: str, text: Column) -> DataFrame:
    narrow = F.col("text").rlike(r"^[\x00-\xff]*$") & (F.col("doc_id") % 2 == 0)
    return documents(spark, d, "text").select(
        F.col("doc_id").cast("string").alias("path"),
        F.when(narrow, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8")).alias("content"),
    )


def charset_filter(spark: SparkSession, d: str) -> DataFrame:
    content = F.col("content")
    decoded = _files(spark, d, F.col("text")).select(
        "path", clean.charset_of(content).alias("charset"), clean.decode_bytes(content).alias("text")
    )
    return decoded.filter(clean.usable_charset(F.col("charset"))).select(
        "path", "charset", F.md5("text").alias("text_md5")
    )


def sanitize_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Raw files with CR LF line ends and a licence around the text."""
    wrapped = F.concat(F.lit("licence\r\n*** START ***\r\n"), "text", F.lit("\r\n*** END ***\r\nlicence"))
    cleaned = jobs.sanitize_corpus(_files(spark, d, wrapped))
    return cleaned.select("path", "charset", F.md5("text").alias("text_md5"))


def rewrite_texts(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned texts as a new version, one directory per charset, read back."""
    wrapped = F.concat(F.lit("*** START ***\r\n"), "text", F.lit("\n*** END"))
    path = fresh_path(spark, "clean")
    sinks.rewrite_texts(jobs.sanitize_corpus(_files(spark, d, wrapped)), path, ("charset",))
    kept = spark.read.schema("path STRING, text STRING, charset STRING").parquet(path)
    return kept.select("path", "charset", F.md5("text").alias("text_md5"))


def first_per_directory(spark: SparkSession, d: str) -> DataFrame:
    return first_per_group(_mirror(spark, d)).select("dir", "file_name", "doc_id")


def first_usable_per_directory(spark: SparkSession, d: str) -> DataFrame:
    return first_per_group(_mirror(spark, d), filter_first=True).select("dir", "file_name", "doc_id")


def _mirror(spark: SparkSession, d: str) -> DataFrame:
    """Directories of three files; some begin with a system file or a readme."""
    i = F.col("doc_id")
    prefix = F.when(i % 7 == 0, ".DS_Store").when(i % 11 == 0, "0readme").otherwise("text")
    return documents(spark, d, "source").select(
        F.concat("source", F.lit("/"), F.floor(i / 3).cast("string")).alias("dir"),
        F.concat(prefix, F.lit("-"), i.cast("string")).alias("file_name"),
        "doc_id",
    )


_MIRROR_SQL = """
mirror as (
  select source || '/' || (doc_id // 3)::varchar as dir,
         case when doc_id % 7 = 0 then '.DS_Store' when doc_id % 11 = 0 then '0readme' else 'text' end
           || '-' || doc_id::varchar as file_name,
         doc_id
  from documents)"""


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles and authors as the given pages spell them, some with odd characters."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return pages(spark, d).select(
        "page_id",
        F.concat(title, F.lit(' a<b>c:d"e/f|g?h*i\\j')).alias("long_title"),
        F.concat(F.substring("url", 1, 30), F.lit("/"), title).alias("author"),
        F.concat(F.substring(title, 1, 40), F.lit(' <b>/x:"y"|?*\\z')).alias("title"),
    )


_TITLES_SQL = """
raw as (select page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as t from pages),
titles as (
  select page_id, t || ' a<b>c:d"e/f|g?h*i\\j' as long_title, substr(url, 1, 30) || '/' || t as author,
         substr(t, 1, 40) || ' <b>/x:"y"|?*\\z' as title
  from raw)"""


def pack_names(spark: SparkSession, d: str) -> DataFrame:
    t = _titles(spark, d)
    return t.select("page_id", names.pack_name(F.col("long_title"), F.col("author")).alias("name"))


def sanitize_names(spark: SparkSession, d: str) -> DataFrame:
    t = _titles(spark, d)
    return t.select("page_id", names.sanitize_name(F.col("title"), F.col("author")).alias("name"))


def unpack_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    packed = documents(spark, d, "lang", "source").select(
        "doc_id",
        F.concat(
            F.lit(" Book "), F.col("doc_id").cast("string"),
            F.when(F.col("doc_id") % 13 == 0, "").otherwise("%%% "), "source", F.lit(".txt by "), "lang", F.lit(".txt"),
        ).alias("name"),
    )
    return packed.select(
        "doc_id", names.title_of(name).alias("title"), names.author_of(name).alias("author")
    )


def url_templates(spark: SparkSession, d: str) -> DataFrame:
    t = _titles(spark, d).filter(F.col("title").isNotNull())
    number = F.col("page_id").cast("string")
    base = "https://books.example"
    return t.select(
        "page_id",
        names.search_url(f"{base}/search", F.col("title"), F.col("author")).alias("search"),
        names.book_page_url(base, number).alias("book"),
        names.download_url(base, number).alias("download"),
        names.info_url(base, number).alias("info"),
    )


def rebased_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(
        F.col("doc_id") % 4 == 0, F.concat("source", F.lit(".txt"))
    ).otherwise(F.concat(F.lit("Z:\\books\\"), "lang", F.lit("\\"), "source", F.lit(".txt")))
    return documents(spark, d, "lang", "source").select(
        "doc_id", names.rebase_path(path, "/shelf/").alias("path")
    )


def read_catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    return files.read_catalog(spark, f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")


QUERIES = {
    "profile_by_source": profile_by_source,
    "profile_corpus": profile_corpus,
    "line_counts": line_counts,
    "line_count_histogram": line_count_histogram,
    "line_count_histogram_fine": line_count_histogram_fine,
    "document_stats": document_stats,
    "header_fields": header_fields,
    "english_only": english_only,
    "english_documents": english_documents,
    "strip_boilerplate": strip_boilerplate,
    "drop_marked_lines": drop_marked_lines,
    "charset_filter": charset_filter,
    "sanitize_corpus": sanitize_corpus,
    "rewrite_texts": rewrite_texts,
    "first_per_group": first_per_directory,
    "first_per_group_usable": first_usable_per_directory,
    "pack_names": pack_names,
    "sanitize_names": sanitize_names,
    "unpack_names": unpack_names,
    "url_templates": url_templates,
    "rebased_paths": rebased_paths,
    "read_catalog_columns": read_catalog_columns,
}

_CHARSETS_SQL = r"""
select doc_id::varchar as path, text,
       case when regexp_full_match(text, '[\x00-\x7f]*') then 'ascii'
            when doc_id % 2 = 0 and regexp_full_match(text, '[\x{0}-\x{ff}]*') then 'ISO-8859-1'
            else 'UTF-8' end as charset
from documents"""

ORACLES = {
    "profile_by_source": f"""
select source, count(*) as n_docs, avg({_LINES}) as avg_lines, avg({_CHARS}) as avg_chars
from documents group by source""",
    "profile_corpus": f"""
select count(*) as n_docs, avg({_LINES}) as avg_lines, avg({_CHARS}) as avg_chars from documents""",
    "line_counts": f"select doc_id, {_LINES}::bigint as n_lines, {_CHARS}::bigint as n_chars from documents",
    "line_count_histogram": _histogram_sql(20, 30000.0),
    "line_count_histogram_fine": _histogram_sql(20, 100.0),
    "document_stats": r"""
with s as (
  select doc_id, text, regexp_extract_all(text, '[^\s.!?][^.!?]*[.!?]*') as ss from documents)
select doc_id, length(text)::bigint as length, len(ss)::bigint as num_sentences,
       round(case when len(ss) > 0 then list_sum([length(x) for x in ss])::double / len(ss) end, 6)
         as avg_sentence_length
from s""",
    "header_fields": f"""
with b as (
  select doc_id,
         case when doc_id % 3 = 0 then ' Book/' || doc_id || ' of ' || source || ' '
              else 'Draft ' || doc_id || case when doc_id % 7 = 2 then chr(133) || 'x' || chr(8232) || 'y' else '' end
              end as raw_title,
         'Writer ' || lang as author,
         replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as body
  from documents where doc_id % 4 <> 0)
select doc_id, trim(raw_title) as title, author,
       replace(trim(raw_title), '/', '') || '%%%' || author || '.txt' as name,
       md5(trim(body, {_STRIP})) as text_md5
from b""",
    "english_only": "select doc_id from documents where doc_id % 4 <> 0",
    "english_documents": "select doc_id from documents where lang = 'en'",
    "strip_boilerplate": f"""
with b as (
  select doc_id, trim(text || case when doc_id % 4 = 1 and doc_id % 5 <> 0
         then chr(133) || '*** END' || chr(8233) || '*** END y' else '' end, {_STRIP}) as body from documents)
select doc_id, length(body)::bigint as n_chars, md5(body) as body_md5 from b""",
    "drop_marked_lines": """
select doc_id, md5(coalesce(list_aggregate(
         [x for x in string_split(text, chr(10)) if not (contains(x, 'the') or contains(x, 'que'))],
         'string_agg', chr(10)), '')) as text_md5
from documents""",
    "charset_filter": f"select path, charset, md5(text) as text_md5 from ({_CHARSETS_SQL})",
    "sanitize_corpus": f"""
select path, charset,
       md5(trim(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {_STRIP})) as text_md5
from ({_CHARSETS_SQL})""",
    "rewrite_texts": f"""
select path, charset,
       md5(trim(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {_STRIP})) as text_md5
from ({_CHARSETS_SQL})""",
    "first_per_group": f"""
with {_MIRROR_SQL},
first as (select *, row_number() over (partition by dir order by file_name) as rn from mirror)
select dir, file_name, doc_id from first
where rn = 1 and not contains(file_name, '.DS') and not contains(file_name, 'readme')""",
    "first_per_group_usable": f"""
with {_MIRROR_SQL},
first as (
  select *, row_number() over (partition by dir order by file_name) as rn from mirror
  where not contains(file_name, '.DS') and not contains(file_name, 'readme'))
select dir, file_name, doc_id from first where rn = 1""",
    "pack_names": f"""
with {_TITLES_SQL}
select page_id, replace(substr(long_title, 1, 100), '/', '') || '%%%'
       || replace(substr(author, 1, 100), '/', '') || '.txt' as name
from titles""",
    "sanitize_names": f"""
with {_TITLES_SQL}
select page_id, translate(substr(title, 1, 100), '<>:"/|?*', '') || '%%%'
       || translate(substr(author, 1, 100), '<>:"/|?*', '') || '.txt' as name
from titles""",
    "unpack_names": """
select doc_id,
       case when doc_id % 13 = 0 then 'Book ' || doc_id || source || '.txt by ' || lang || '.txt'
            else 'Book ' || doc_id end as title,
       case when doc_id % 13 = 0 then null else source || ' by ' || lang end as author
from documents""",
    "url_templates": f"""
with {_TITLES_SQL}
select page_id,
       'https://books.example/search?q=intitle:' || replace(title, ' ', '%20') || '+inauthor:'
         || replace(author, ' ', '%20') as search,
       'https://books.example/book/isbn/' || page_id as book,
       'https://books.example/send/1:text:.txt:text/' || page_id || '/' || page_id || '.txt' as download,
       'https://books.example/titles/' || page_id || '.html' as info
from titles""",
    "rebased_paths": "select doc_id, '/shelf/' || source || '.txt' as path from documents",
    "read_catalog_columns": "select o_orderkey, o_custkey, o_orderstatus from orders",
}
