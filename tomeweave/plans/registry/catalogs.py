"""Tag consolidation, catalog maintenance, status and incremental queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.functions.identifiers import safe_isbn_number
from tomeweave.functions.names import pack_name
from tomeweave.operators import catalog as cat
from tomeweave.operators import labels
from tomeweave.plans.registry.tables import documents, rows, sql_list, table
from tomeweave.sources import sinks
from tomeweave.sources.workspace import fresh_path
from tomeweave.streaming.ingest import ingest_first_per_key, ingest_new, stream_table
from tomeweave.vocab import FOLDED_TAGS, HISTORY_TAGS, MAIN_TAGS, OTHER_TAGS

# Tags the events stand for: every kind of rule, and some without a rule.
TAGS = (
    "fiction", "non-fiction", "war", "travel", "mystery", "love", "history", "adventure", "classics",
    "memoir", "magic", "poetry", "roman", "self-help", "science-fiction-fantasy", "epic", "fantasy",
)


def _tag_votes(spark: SparkSession, d: str) -> DataFrame:
    """Four events make a book; each votes for a tag."""
    pick = F.element_at(
        F.array(*[F.lit(t) for t in TAGS]),
        (1 + (F.col("event_id") * 7 + F.col("user_id")) % len(TAGS)).cast("int"),
    )
    votes = rows(spark, d, "events", "event_id").select(
        F.floor(F.col("event_id") / 4).alias("entity"), pick.alias("label"), F.floor("value").alias("v")
    )
    return votes.groupBy("entity", "label").agg(F.sum("v").cast("bigint").alias("weight"))


def consolidate_labels(spark: SparkSession, d: str) -> DataFrame:
    mapped = labels.consolidate(_tag_votes(spark, d))
    return labels.explode_tags(mapped, ["entity", "gtype"])


def label_type(spark: SparkSession, d: str) -> DataFrame:
    return labels.consolidate(_tag_votes(spark, d)).select("entity", "gtype")


def tag_maps(spark: SparkSession, d: str) -> DataFrame:
    """Tags as a map per book and back."""
    maps = labels.collect_tags(_tag_votes(spark, d), ["entity"])
    return labels.explode_tags(maps, ["entity"], "tags")


def top_labels(spark: SparkSession, d: str) -> DataFrame:
    votes = _tag_votes(spark, d).groupBy("label").agg(F.sum("weight").cast("bigint").alias("n"))
    return labels.top_labels(votes, 10)


# Catalogs in the listing schema, from the orders of some status.
def _catalog(spark: SparkSession, d: str, *status: str) -> DataFrame:
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    path = F.concat(F.lit("Z:\\books\\"), "o_orderpriority", F.lit("\\"), key, F.lit(".txt"))
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin(*status)).select(
        F.concat(F.lit("Title "), (F.col("o_orderkey") % 700).cast("string")).alias("title"),
        F.concat(F.lit("Author "), (F.col("o_custkey") % 5).cast("string")).alias("author"),
        F.col("o_orderpriority").alias("genre"),
        path.alias("local_file"),
        F.concat(F.lit("dl/"), key).alias("dl_url"),
        F.concat(F.lit("info/"), customer).alias("info_url"),
    )


def _combined(spark: SparkSession, d: str, dedupe: bool) -> DataFrame:
    source, target = _catalog(spark, d, "O", "P"), _catalog(spark, d, "F")
    return cat.combine(source, target, "1-URGENT", "/shelf/", dedupe=dedupe)


def combine_catalogs(spark: SparkSession, d: str) -> DataFrame:
    return _combined(spark, d, dedupe=False)


def combine_catalogs_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return _combined(spark, d, dedupe=True)


def filter_catalog(spark: SparkSession, d: str) -> DataFrame:
    return cat.filter_equals(_catalog(spark, d, "F", "O", "P"), "genre", "2-HIGH").select("title", "author", "dl_url")


def filter_categories(spark: SparkSession, d: str) -> DataFrame:
    return cat.filter_in(documents(spark, d, "lang"), "lang", ["de", "es"])


def anti_existing(spark: SparkSession, d: str) -> DataFrame:
    return cat.without_existing(documents(spark, d, "source"), table(spark, d, "labels"), "doc_id")


def semi_existing(spark: SparkSession, d: str) -> DataFrame:
    return cat.with_existing(documents(spark, d, "source"), table(spark, d, "labels"), "doc_id")


def _first_candidate(spark: SparkSession, d: str, legacy: bool) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    numbers = F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: ((c * 7 + i * (13 + k % 5)) % 2000).cast("string")
    )
    books = rows(spark, d, "orders", "o_orderkey").select(
        k.alias("file_name"),
        F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(numbers).alias("ids"),
    )
    customers = table(spark, d, "customer")
    isbn = F.col("c_custkey").cast("string").alias("isbn")
    catalog = customers.filter(F.col("c_mktsegment") == "BUILDING").select(isbn)
    tagged = customers.filter(F.col("c_acctbal") < 0).select(isbn)
    return cat.resolve_candidates(books, catalog, tagged, legacy=legacy)


def first_candidate(spark: SparkSession, d: str) -> DataFrame:
    return _first_candidate(spark, d, legacy=False)


def first_candidate_legacy(spark: SparkSession, d: str) -> DataFrame:
    return _first_candidate(spark, d, legacy=True)


def _named_files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    prefix = F.when(i % 4 == 0, "$$$").when(i % 4 == 1, "~~~").otherwise("")
    suffix = F.when(i % 10 == 2, "$$$").otherwise("")
    name = F.concat(prefix, "source", F.lit("%%%"), i.cast("string"), suffix, F.lit(".txt"))
    return documents(spark, d, "source").select("doc_id", name.alias("file_name"))


def pending_only(spark: SparkSession, d: str) -> DataFrame:
    return cat.pending(_named_files(spark, d))


def reset_status(spark: SparkSession, d: str) -> DataFrame:
    files = _named_files(spark, d)
    ledger = files.withColumn("status", cat.status_of_name(F.col("file_name")))
    reset = cat.reset_status(ledger, "skipped")
    return cat.reset_names(reset, "~~~")


def resume_marker(spark: SparkSession, d: str) -> DataFrame:
    listing = documents(spark, d, "source").select(F.col("source").alias("dir"), F.col("doc_id").alias("pos"))
    return cat.resume_from(listing, "src7")


def safe_isbn_cast(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    check = F.when(k % 11 == 10, "X").otherwise((k % 11).cast("string"))
    isbn = F.concat(F.lpad(k.cast("string"), 9, "0"), check)
    keys = table(spark, d, "orders").select("o_orderkey", isbn.alias("isbn"))
    return keys.withColumn("number", safe_isbn_number(F.col("isbn")))


def upsert_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders replace their rows; the new version is written and read back."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("isbn"), "o_orderstatus", "o_orderpriority")
    old = orders.filter(F.col("o_orderstatus") != "P").select("isbn", F.col("o_orderstatus").alias("gtype"))
    urgent = orders.filter(F.col("o_orderpriority") == "1-URGENT")
    # Every new row comes twice; the greater one counts.
    new = urgent.select("isbn", F.explode(F.array(F.lit("new"), F.lit("held"))).alias("gtype"))
    path = fresh_path(spark, "catalog")
    sinks.write_upsert(old, new, ["isbn"], path)
    return spark.read.parquet(path)


def upsert_in_place(spark: SparkSession, d: str) -> DataFrame:
    """The same into a table laid out by the key, first the old rows, then the new ones twice."""
    orders = table(spark, d, "orders")
    path, isbn = fresh_path(spark, "catalog"), F.col("o_orderkey").cast("string").alias("isbn")
    sinks.upsert_in_place(
        orders.filter("o_orderstatus <> 'P'").select(isbn, F.col("o_orderstatus").alias("gtype")), ["isbn"], path
    )
    urgent = orders.filter("o_orderpriority = '1-URGENT'")
    for _ in range(2):
        sinks.upsert_in_place(urgent.select(isbn, F.lit("new").alias("gtype")), ["isbn"], path)
    return spark.read.parquet(path).select("isbn", "gtype")


def append_catalog(spark: SparkSession, d: str) -> DataFrame:
    """An empty table is set up, then the entries with a file are appended to it."""
    path = fresh_path(spark, "catalog")
    sinks.ensure_table(spark, path, cat.LISTING_SCHEMA)
    entries = _catalog(spark, d, "O").withColumn("name", F.col("dl_url"))
    files = table(spark, d, "orders").filter(F.col("o_totalprice") < 100000).select(
        F.concat(F.lit("dl/"), F.col("o_orderkey").cast("string")).alias("name")
    )
    sinks.append_existing(entries, files, path)
    sinks.append_rows(_catalog(spark, d, "F", "P"), path)
    return spark.read.schema(cat.LISTING_SCHEMA).parquet(path)


def write_texts(spark: SparkSession, d: str) -> DataFrame:
    """Books of one file name overwrite each other."""
    title = F.concat("source", F.lit("-"), (F.col("doc_id") % 300).cast("string"))
    books = documents(spark, d, "lang", "source", "text").select(
        pack_name(title, F.col("source")).alias("name"),
        F.col("lang").alias("label"),
        "doc_id",
        "text",
    )
    path = fresh_path(spark, "texts")
    sinks.write_texts(books, path, [F.col("doc_id")])
    return spark.read.parquet(path).select("name", "label", "doc_id", F.md5("text").alias("text_md5"))


def _documents_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "documents").schema
    # A pattern, as the table may be one file as well as a directory of them.
    return stream_table(spark, f"{d}/documents.parquet*", schema)


def ingest_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Files already ingested are not read again: the second run adds nothing."""
    path = fresh_path(spark, "ingested")
    rows = _documents_stream(spark, d).select("doc_id", "source", F.md5("text").alias("text_md5"))
    for _ in range(2):
        ingest_new(rows, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def ingest_first_writer(spark: SparkSession, d: str) -> DataFrame:
    """One row per text, the first document that brings it."""
    path = fresh_path(spark, "first")
    rows = _documents_stream(spark, d).select(F.md5("text").alias("text_md5"), "doc_id", "source")
    ingest_first_per_key(rows, path, f"{path}-checkpoint", ["text_md5"], [F.col("doc_id")]).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path).drop("batch")


QUERIES = {
    "consolidate_labels": consolidate_labels,
    "label_type": label_type,
    "tag_maps": tag_maps,
    "top_labels": top_labels,
    "combine_catalogs": combine_catalogs,
    "combine_catalogs_dedupe": combine_catalogs_dedupe,
    "filter_catalog": filter_catalog,
    "filter_categories": filter_categories,
    "anti_existing": anti_existing,
    "semi_existing": semi_existing,
    "first_candidate": first_candidate,
    "first_candidate_legacy": first_candidate_legacy,
    "pending_only": pending_only,
    "reset_status": reset_status,
    "resume_marker": resume_marker,
    "safe_isbn_cast": safe_isbn_cast,
    "upsert_catalog": upsert_catalog,
    "upsert_in_place": upsert_in_place,
    "append_catalog": append_catalog,
    "write_texts": write_texts,
    "ingest_incremental": ingest_incremental,
    "ingest_first_writer": ingest_first_writer,
}

_VOTES_SQL = f"""
votes as (
  select event_id // 4 as entity, ([{sql_list(TAGS)}])[1 + (event_id * 7 + user_id) % {len(TAGS)}] as label,
         sum(floor(value)::bigint)::bigint as weight
  from events group by all),
types as (
  select entity, case when bool_or(label = 'fiction') then 'fiction'
                      when bool_or(label = 'non-fiction') then 'non-fiction' else '' end as gtype
  from votes group by entity)"""

_FOLDED_SQL = " ".join(f"when label = '{tag}' then '{main}'" for tag, main in FOLDED_TAGS.items())
TARGET_SQL = f"""
case when label in ({sql_list(MAIN_TAGS)}) then label {_FOLDED_SQL}
     when label in ({sql_list(HISTORY_TAGS)}) and gtype = 'fiction' then 'historical-fiction'
     when label in ({sql_list(HISTORY_TAGS)}) and gtype = 'non-fiction' then 'history'
     when label in ({sql_list(OTHER_TAGS)}) and gtype = 'fiction' then 'general-fiction'
     when label in ({sql_list(OTHER_TAGS)}) and gtype = 'non-fiction' then 'other' end"""


def _catalog_sql(*status: str) -> str:
    return f"""
select 'Title ' || (o_orderkey % 700) as title, 'Author ' || (o_custkey % 5) as author,
       o_orderpriority as genre, 'Z:\\books\\' || o_orderpriority || '\\' || o_orderkey || '.txt' as local_file,
       'dl/' || o_orderkey as dl_url, 'info/' || o_custkey as info_url
from orders where o_orderstatus in ({sql_list(status)})"""


_BOTH_SQL = f"""
source as ({_catalog_sql("O", "P")}),
target as ({_catalog_sql("F")}),
combined as (
  select *, 0 as origin from target
  union all
  select title, author, genre, '/shelf/' || string_split(local_file, '\\')[-1], dl_url, info_url, 1
  from source where genre = '1-URGENT')"""


def _first_candidate_sql(duplicate: str) -> str:
    return f"""
with books as (
  select o_orderkey as file_name, unnest(generate_series(0, 3)) as pos, o_custkey as c from orders
  where o_orderkey % 11 <> 0),
candidates as (select file_name, pos, (c * 7 + pos * (13 + file_name % 5)) % 2000 as id from books),
hits as (
  select file_name, pos, id, c_mktsegment = 'BUILDING' as held,
         row_number() over (partition by file_name order by pos) as rn
  from candidates join customer on id = c_custkey where c_mktsegment = 'BUILDING' or c_acctbal < 0),
stops as (
  select *, row_number() over (partition by id, held order by file_name) as claim from hits where rn = 1)
select o_orderkey as file_name, id::varchar as isbn,
       case when id is null then 'skipped' when not held and claim = 1 then 'processed'
            else '{duplicate}' end as status
from orders left join stops on o_orderkey = stops.file_name"""


_FILES_SQL = """
files as (
  select doc_id, case when doc_id % 4 = 0 then '$$$' when doc_id % 4 = 1 then '~~~' else '' end
         || source || '%%%' || doc_id || case when doc_id % 10 = 2 then '$$$' else '' end || '.txt' as file_name
  from documents)"""
_STATUS_SQL = """
case when contains(file_name, '$$$') then 'processed' when contains(file_name, '~~~') then 'skipped'
     else 'pending' end"""

ORACLES = {
    "consolidate_labels": f"""
with {_VOTES_SQL},
mapped as (
  select entity, gtype, {TARGET_SQL} as target, weight from votes join types using (entity))
select entity, gtype, target as label, max(weight)::bigint as weight from mapped
where target is not null group by all""",
    "label_type": f"with {_VOTES_SQL} select entity, gtype from types",
    "tag_maps": f"with {_VOTES_SQL} select entity, label, weight from votes",
    "top_labels": f"""
with {_VOTES_SQL}
select label, sum(weight)::bigint as n from votes group by label order by n desc, label limit 10""",
    "combine_catalogs": f"""
with {_BOTH_SQL} select title, author, genre, local_file, dl_url, info_url from combined""",
    "combine_catalogs_dedupe": f"""
with {_BOTH_SQL}
select title, author, genre, local_file, dl_url, info_url from (
  select *, row_number() over (
    partition by title, author order by origin, genre, local_file, dl_url, info_url) as rn
  from combined) where rn = 1""",
    "filter_catalog": f"select title, author, dl_url from ({_catalog_sql('F', 'O', 'P')}) where genre = '2-HIGH'",
    "filter_categories": "select doc_id, lang from documents where lang in ('de', 'es')",
    "anti_existing": "select doc_id, source from documents where doc_id not in (select doc_id from labels)",
    "semi_existing": "select doc_id, source from documents where doc_id in (select doc_id from labels)",
    "first_candidate": _first_candidate_sql("duplicate"),
    "first_candidate_legacy": _first_candidate_sql("pending"),
    "pending_only": f"""
with {_FILES_SQL} select doc_id, file_name from files where {_STATUS_SQL} = 'pending'""",
    "reset_status": f"""
with {_FILES_SQL}
select doc_id, regexp_replace(file_name, '^~~~', '') as file_name,
       case when {_STATUS_SQL} = 'skipped' then 'pending' else {_STATUS_SQL} end as status
from files""",
    "resume_marker": """
select source as dir, doc_id as pos from documents
where doc_id >= (select min(doc_id) from documents where source = 'src7')""",
    "safe_isbn_cast": """
with k as (
  select o_orderkey, lpad(o_orderkey::varchar, 9, '0')
         || case when o_orderkey % 11 = 10 then 'X' else (o_orderkey % 11)::varchar end as isbn
  from orders)
select o_orderkey, isbn, try_cast(isbn as bigint) as number from k""",
    "upsert_catalog": """
select o_orderkey::varchar as isbn,
       case when o_orderpriority = '1-URGENT' then 'new' else o_orderstatus end as gtype
from orders where o_orderstatus <> 'P' or o_orderpriority = '1-URGENT'""",
    "upsert_in_place": """
select o_orderkey::varchar as isbn,
       case when o_orderpriority = '1-URGENT' then 'new' else o_orderstatus end as gtype
from orders where o_orderstatus <> 'P' or o_orderpriority = '1-URGENT'""",
    "append_catalog": f"""
select c.* from ({_catalog_sql("O")}) c
where c.dl_url in (select 'dl/' || o_orderkey from orders where o_totalprice < 100000)
union all
select c.* from ({_catalog_sql("F", "P")}) c""",
    "write_texts": """
select source || '-' || (doc_id % 300) || '%%%' || source || '.txt' as name, lang as label, doc_id, text_md5 from (
  select source, lang, doc_id, md5(text) as text_md5,
         row_number() over (partition by source || '-' || (doc_id % 300), source order by doc_id desc) as rn
  from documents)
where rn = 1""",
    "ingest_incremental": "select doc_id, source, md5(text) as text_md5 from documents",
    "ingest_first_writer": """
select md5(text) as text_md5, min(doc_id) as doc_id, arg_min(source, doc_id) as source
from documents group by md5(text)""",
}
