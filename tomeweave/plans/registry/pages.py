"""Extraction from stored pages and responses, and the jobs built on it.

The given pages hold link lists only, so book, listing and category pages in the layout the
extractors expect are composed from the given tables first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave import vocab
from tomeweave.functions import names
from tomeweave.functions.identifiers import extract_identifiers, parse_response
from tomeweave.functions.sections import extract_section
from tomeweave.operators import catalog as cat
from tomeweave.operators import extract, labels
from tomeweave.plans import jobs
from tomeweave.plans.registry import tables
from tomeweave.plans.registry.catalogs import TAGS, TARGET_SQL
from tomeweave.plans.registry.tables import rows, sql_list, table
from tomeweave.sources import sinks
from tomeweave.sources.workspace import fresh_path, materialise

BASE = "https://books.example"
ROOT = "/shelf"
_LINK = r'<a href="/([^"]*)">([^<]*)</a>'


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _event_tag() -> Column:
    index = (1 + (F.col("event_id") * 7 + F.col("user_id")) % len(TAGS)).cast("int")
    return F.element_at(F.array(*[F.lit(t) for t in TAGS]), index)


def _page_of_lines(events: DataFrame, size: int, key: str, head: str, line: Column, tail: str) -> DataFrame:
    """One page per ``size`` neighbouring events, a few lines for each of them."""
    lines = F.array_sort(F.collect_list(F.struct("event_id", line.alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "")
    pages = events.groupBy(F.floor(F.col("event_id") / size).alias(key)).agg(body.alias("body"))
    return pages.select(key, _text(head, F.col("body"), tail).alias("html"))


def _book_pages(spark: SparkSession, d: str) -> DataFrame:
    i, tag = F.col("event_id"), _event_tag()
    name = _text(
        f'  {vocab.TAG_NAME_LINE} href="/genres/', tag, '">', tag, "</a>",
        F.when(i % 7 == 0, " &gt; more").otherwise(""), "\n",
    )
    count = F.when(i % 3 != 0, _text('  <a title="', i % 1000, ' people shelved this">')).otherwise("")
    below = F.when(i % 3 != 0, F.concat(name, count, F.lit("\n"))).otherwise(name)
    # Some counts stand before the name on its own line.
    line = F.when((i % 4 == 1) & (i % 7 != 0), F.concat(count, name)).otherwise(below)
    return _page_of_lines(
        rows(spark, d, "events", "event_id"),
        40,
        "isbn",
        f'<html>\n{vocab.TAG_NAME_LINE} href="/genres/before">\n<p>{vocab.TAG_SECTION_START}1">shelves\n',
        line,
        f'{vocab.TAG_SECTION_END} href="#">more</a>\n{vocab.TAG_NAME_LINE} href="/genres/after">\n</html>',
    )


def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return extract.tag_counts(_book_pages(spark, d), ["isbn"]).select("isbn", "label", "n")


def _listing_pages(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    name = _text(
        f"\t{vocab.LISTING_NAME_LINE}x\">", F.col("event_type"), "-", F.col("user_id") % 40, "</a>\n"
    )
    count = F.when(i % 5 != 0, _text("   ", F.format_number(i * 37, 0), " books\n")).otherwise("no count\n")
    return _page_of_lines(
        rows(spark, d, "events", "event_id"),
        500,
        "page",
        f"9,999 before\n{vocab.LISTING_SECTION_START}\n12 before any name\n",
        F.concat(name, count),
        f'{vocab.LISTING_SECTION_END}\n{vocab.LISTING_NAME_LINE}x">after</a>\n1 books\n',
    )


def listing_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.collect_listing(_listing_pages(spark, d))


def top_listing(spark: SparkSession, d: str) -> DataFrame:
    return jobs.collect_listing(_listing_pages(spark, d), top=100)


def listing_entries(spark: SparkSession, d: str) -> DataFrame:
    entries = extract.section_entries(
        tables.pages(spark, d), ["page_id"], "<nav>", "</nav>", _LINK, {"id": 1, "title": 2}
    )
    return entries.withColumn("info_url", names.info_url(BASE, F.col("id")))


def _category_html() -> Column:
    links = F.regexp_replace(
        extract_section(F.col("html"), "<nav>", "</nav>"),
        rf"<li>{_LINK}</li>",
        '<a href="/titles/$1.html">$2</a> by<br />Author $1 \n',
    )
    return _text(
        '<a href="/titles/before.html">x</a>\n', vocab.CATEGORY_SECTION_START, "\n",
        links, "\n", vocab.CATEGORY_SECTION_END, '\n<a href="/titles/after.html">x</a>\n',
    )


def category_entries(spark: SparkSession, d: str) -> DataFrame:
    pages = tables.pages(spark, d).select("page_id", _category_html().alias("html"))
    return extract.category_entries(pages, ["page_id"], BASE)


def _shelves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every page belongs to a region's category; a category has as many pages as fall to it."""
    number = F.col("page_id")
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("genre"))
    store = (
        tables.pages(spark, d)
        .select((number % 5).cast("int").alias("r"), F.floor(number / 5).alias("p"), _category_html().alias("html"))
        .join(regions, "r")
        .select(
            "genre",
            F.when(F.col("p") % 6 != 5, names.category_page_url(BASE, F.upper("genre"), F.col("p") + 1))
            .otherwise("lost").alias("url"),
            "html",
        )
    )
    categories = store.groupBy("genre").agg(F.count("*").alias("pages"))
    return categories.withColumn("category", F.upper("genre")), store.select("url", "html")


def listing_books(spark: SparkSession, d: str) -> DataFrame:
    categories, store = _shelves(spark, d)
    return jobs.listing_entries(categories, store, BASE, ROOT).select("local_file", "page", "id", "title")


def known_shelf_books(spark: SparkSession, d: str) -> DataFrame:
    """The seven known categories; pages beyond a category's own are not asked for."""
    number, codes = F.col("page_id"), [code for _, code, _ in vocab.SHELF_PAGES]
    code = F.element_at(F.array(*map(F.lit, codes)), (number % len(codes) + 1).cast("int"))
    url = names.category_page_url(BASE, code, F.floor(number / len(codes)) + 1)
    store = tables.pages(spark, d).select(url.alias("url"), _category_html().alias("html"))
    entries = jobs.listing_entries(None, store, BASE, ROOT)
    return entries.select("local_file", "genre", "category", "page", "id", "title")


def listing_catalog(spark: SparkSession, d: str) -> DataFrame:
    """One shelf was filled before, and the files of another did not arrive."""
    categories, store = _shelves(spark, d)
    # Stored: both sides are read from it, and pages are costly to parse.
    files = materialise(jobs.listing_entries(categories, store, BASE, ROOT).select("local_file"), "files")
    before = files.filter(F.contains("local_file", F.lit("/ASIA/")))
    now = files.filter(~F.contains("local_file", F.lit("/AFRICA/")))
    return jobs.build_listing_catalog(categories, store, before, now, BASE, ROOT)


def pages_per_category(spark: SparkSession, d: str) -> DataFrame:
    """Ten customers of a nation fill a page."""
    sizes = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.ceil(F.count("*") / 10).cast("bigint").alias("pages")
    )
    categories = table(spark, d, "nation").join(sizes, "n_nationkey").select(F.col("n_name").alias("category"), "pages")
    return extract.category_pages(categories, BASE)


def pages_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Wanted addresses, some of which the store lacks."""
    events = table(spark, d, "events").select("event_id", (F.col("event_id") % 400).alias("page_id"))
    known = tables.pages(spark, d).select("page_id", "url")
    wanted = events.join(known, "page_id", "left").select(
        "event_id", F.coalesce("url", F.lit("https://missing.example")).alias("url")
    )
    store = tables.pages(spark, d).select("url", F.length("html").cast("bigint").alias("n_chars"))
    return cat.lookup(wanted, store, ["url"])


def _responses(key: Column, items: Column, entry) -> Column:
    """A search response: ``entry(i)`` gives the identifier list of item ``i`` or NULL."""

    def item(i: Column) -> Column:
        ids = entry(i)
        return F.when(ids.isNull(), _text('{"volumeInfo": {"title": "t"}}')).otherwise(
            _text('{"volumeInfo": {"industryIdentifiers": [', ids, "]}}")
        )

    numbers = F.when(items > 0, F.sequence(F.lit(1).cast("bigint"), items)).otherwise(F.array().cast("array<bigint>"))
    body = F.array_join(F.transform(numbers, item), ", ")
    return F.when(items == 0, _text('{"kind": "none"}')).otherwise(_text('{"items": [', body, "]}"))


def _identifier(kind: str, value: Column) -> Column:
    return _text(f'{{"type": "{kind}", "identifier": "', value, '"}')


def identifiers_from_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")

    def entry(i: Column) -> Column:
        short = _identifier("ISBN_10", _text("S", k * 10 + i))
        long = _identifier("ISBN_13", _text("L", k * 10 + i))
        other = _identifier("OTHER", _text("O", k))
        kind = (k + i) % 4
        return (
            F.when((k % 7 == 0) & (i == 3), None)
            .when(kind == 1, long)
            .when(kind == 2, _text(other, ", ", short))
            .when(kind == 3, _text(_identifier("ISBN_13", F.lit("first")), ", ", long, ", ", short))
            .otherwise(_text(short, ", ", long))
        )

    orders = rows(spark, d, "orders", "o_orderkey").select("o_orderkey", _responses(k, k % 6, entry).alias("body"))
    ids = extract_identifiers(parse_response(F.col("body")))
    return orders.select("o_orderkey", ids.alias("ids")).select(
        "o_orderkey", F.size("ids").cast("bigint").alias("n_ids"), F.array_join("ids", ",").alias("ids")
    )


def _catalog_update(spark: SparkSession, d: str) -> jobs.CatalogUpdate:
    i = F.col("doc_id")
    docs = tables.documents(spark, d, "lang", "source")
    prefix = F.when(i % 10 == 0, "$$$").when(i % 10 == 1, "~~~").otherwise("")
    books = docs.select(_text(prefix, "Book ", i, "%%%", F.col("source"), ".txt").alias("file_name"))

    def entry(n: Column) -> Column:
        first = _identifier("ISBN_10", (i * 3) % 150)
        return F.when(n == 1, first).otherwise(_identifier("ISBN_13", F.floor(i / 2) % 300))

    # No search was answered for the Spanish texts.
    responses = docs.filter(F.col("lang") != "es").select(
        _text("Book ", i).alias("title"),
        F.col("source").alias("author"),
        _responses(i, F.lit(2).cast("bigint"), entry).alias("body"),
    )
    pages = _book_pages(spark, d).select(
        names.book_page_url(BASE, F.col("isbn").cast("string")).alias("url"), "html"
    )
    held = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    catalog = held.select(F.col("c_custkey").cast("string").alias("isbn"))
    return jobs.build_catalog(books, responses, pages, catalog, BASE)


def build_catalog(spark: SparkSession, d: str) -> DataFrame:
    rows = _catalog_update(spark, d).rows
    return labels.explode_tags(rows, ["isbn", "title", "author", "gtype"], "genres_mapped")


def build_catalog_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _catalog_update(spark, d).ledger


def append_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger of two batches; in the second the skipped books are pending again."""
    path = fresh_path(spark, "ledger")
    resolved = materialise(_catalog_update(spark, d).ledger, "resolved")
    sinks.append_ledger(resolved, "first", path)
    sinks.append_ledger(cat.reset_status(resolved, "skipped"), "second", path)
    return spark.read.parquet(path)


QUERIES = {
    "tag_counts": tag_counts,
    "listing_counts": listing_counts,
    "top_listing": top_listing,
    "listing_entries": listing_entries,
    "category_entries": category_entries,
    "listing_books": listing_books,
    "known_shelf_books": known_shelf_books,
    "listing_catalog": listing_catalog,
    "pages_per_category": pages_per_category,
    "pages_lookup": pages_lookup,
    "identifiers_from_json": identifiers_from_json,
    "build_catalog": build_catalog,
    "build_catalog_ledger": build_catalog_ledger,
    "append_ledger": append_ledger,
}


def _attached_sql(size: int, named: str, counted: str, label: str, n: str) -> str:
    """Names and the last count below each, from the events the pages were composed of."""
    return f"""
lines as (
  select event_id // {size} as page, event_id, {named} as named, {label} as label,
         case when {counted} then {n} end as n
  from events),
runs as (
  select *, sum(named::int) over (partition by page order by event_id) as run from lines),
entries as (
  select page, run, arg_min(label, event_id) as label,
         coalesce(arg_max(n, event_id) filter (n is not null), 0)::bigint as n
  from runs where run > 0 group by page, run),
last_places as (
  select page, run, label, n from (
    select *, row_number() over (partition by page, label order by run desc) as rn from entries)
  where rn = 1)"""


_TAG_SQL = _attached_sql(
    40,
    "event_id % 7 <> 0",
    # The line of a skipped name still lets its count through to the name before.
    "event_id % 3 <> 0",
    f"([{sql_list(TAGS)}])[1 + (event_id * 7 + user_id) % {len(TAGS)}]",
    "event_id % 1000",
)
_LISTING_SQL = _attached_sql(
    500, "true", "event_id % 5 <> 0", "event_type || '-' || (user_id % 40)", "event_id * 37"
) + """,
merged as (select label, arg_max(n, page * 1000 + run) as n from last_places group by label)"""

_NAV_SQL = rf"""
nav as (select page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) as nav from pages),
links as (
  select page_id, unnest(regexp_extract_all(nav, '{_LINK}', 1)) as id,
         unnest(regexp_extract_all(nav, '{_LINK}', 2)) as title
  from nav)"""

_LISTED_SQL = f"""
{_NAV_SQL},
listed as (
  select r_name as genre, upper(r_name) as category, page_id // 5 + 1 as page, id, title,
         'Author ' || trim(id) as author
  from links join region on r_regionkey = page_id % 5
  where (page_id // 5) % 6 <> 5),
filed as (
  select *, '{ROOT}/' || genre || '/' || translate(substr(title, 1, 100), '<>:"/|?*', '') || '%%%'
            || translate(substr(author, 1, 100), '<>:"/|?*', '') || '.txt' as local_file
  from listed),
books as (
  select * from (
    select *, row_number() over (
      partition by local_file order by category, page, id, title, author) as rn
    from filed) where rn = 1)"""

_LEDGER_SQL = f"""
{_TAG_SQL},
todo as (
  select doc_id, lang, source, 'Book ' || doc_id || '%%%' || source || '.txt' as file_name
  from documents where doc_id % 10 > 1),
candidates as (
  select doc_id, 1 as pos, (doc_id * 3) % 150 as id from todo where lang <> 'es'
  union all
  select doc_id, 2, (doc_id // 2) % 300 from todo where lang <> 'es'),
known as (
  select id, bool_or(held) as held from (
    select c_custkey as id, true as held from customer where c_mktsegment = 'BUILDING'
    union all select page, false from last_places) group by id),
hits as (
  select c.*, k.held, row_number() over (partition by doc_id order by pos) as rn
  from candidates c join known k using (id)),
stops as (
  select h.doc_id, h.id, h.held,
         row_number() over (partition by h.id, h.held order by t.file_name) as claim
  from hits h join todo t using (doc_id) where rn = 1),
ledger as (
  select t.doc_id, t.source, t.file_name, s.id,
         case when s.id is null then 'skipped' when not held and claim = 1 then 'processed'
              else 'duplicate' end as status
  from todo t left join stops s using (doc_id))"""


_BUILT_SQL = f"""
with {_LEDGER_SQL},
types as (
  select page, case when bool_or(label = 'fiction') then 'fiction'
                    when bool_or(label = 'non-fiction') then 'non-fiction' else '' end as gtype
  from last_places group by page),
mapped as (
  select page, gtype, {TARGET_SQL} as target, n from last_places join types using (page))
select id::varchar as isbn, 'Book ' || doc_id as title, source as author, gtype, target as label,
       max(n)::bigint as weight
from ledger join mapped on page = id
where status = 'processed' and target is not null
group by all"""


ORACLES = {
    "tag_counts": f"with {_TAG_SQL} select page as isbn, label, n from last_places",
    "listing_counts": f"with {_LISTING_SQL} select label, n from merged",
    "top_listing": f"with {_LISTING_SQL} select label, n from merged order by n desc, label limit 100",
    "listing_entries": f"""
with {_NAV_SQL}
select page_id, id, title, '{BASE}/titles/' || id || '.html' as info_url from links""",
    "category_entries": f"""
with {_NAV_SQL}
select page_id, id, title, 'Author ' || trim(id) as author,
       '{BASE}/send/1:text:.txt:text/' || id || '/' || id || '.txt' as dl_url,
       '{BASE}/titles/' || id || '.html' as info_url
from links""",
    "listing_books": f"with {_LISTED_SQL} select local_file, page, id, title from books",
    "known_shelf_books": f"""
with {_NAV_SQL},
shelves(genre, category, pages, k) as (
  values ('Adventure', 'ADV', 90, 0), ('Biography', 'BIO', 88, 1), ('History', 'HIS', 160, 2),
         ('Mystery-Horror', 'MYS', 43, 3), ('Poetry', 'POE', 71, 4), ('Romance', 'ROM', 80, 5),
         ('Science Fiction', 'SFC', 69, 6)),
listed as (
  select genre, category, page_id // 7 + 1 as page, id, title, 'Author ' || trim(id) as author
  from links join shelves on k = page_id % 7 where page_id // 7 + 1 <= pages),
filed as (
  select *, '{ROOT}/' || genre || '/' || translate(substr(title, 1, 100), '<>:"/|?*', '') || '%%%'
            || translate(substr(author, 1, 100), '<>:"/|?*', '') || '.txt' as local_file
  from listed)
select local_file, genre, category, page, id, title from (
  select *, row_number() over (partition by local_file order by category, page, id, title, author) as rn from filed)
where rn = 1""",
    "listing_catalog": f"""
with {_LISTED_SQL}
select title, author, genre, local_file,
       '{BASE}/send/1:text:.txt:text/' || id || '/' || id || '.txt' as dl_url,
       '{BASE}/titles/' || id || '.html' as info_url
from books where genre not in ('ASIA', 'AFRICA')""",
    "pages_per_category": f"""
with sizes as (
  select n_name as category, ceil(count(*) / 10.0)::bigint as pages
  from customer join nation on c_nationkey = n_nationkey group by n_name),
numbered as (select category, unnest(generate_series(1, pages)) as page from sizes)
select category, page, '{BASE}/categories/' || category || '/' || page || '/en' as url from numbered""",
    "pages_lookup": """
select e.event_id, p.url, length(p.html)::bigint as n_chars
from events e join pages w on w.page_id = e.event_id % 400 join pages p on p.url = w.url""",
    "identifiers_from_json": """
with items as (
  select o_orderkey as k, unnest(generate_series(1, o_orderkey % 6)) as i from orders),
kinds as (
  select k, i, (k + i) % 4 <> 2 as has_long, (k + i) % 4 <> 1 as has_short,
         k % 7 = 0 and i = 3 as lacking
  from items),
sums as (
  select *, coalesce(sum(has_long::int + has_short::int) over (
              partition by k order by i rows between unbounded preceding and 1 preceding), 0) as held,
         bool_or(lacking) over (partition by k order by i) as stopped
  from kinds),
ids as (
  select k, i, 1 as o, 'L' || (k * 10 + i) as id from sums where not stopped and held < 6 and has_long
  union all
  select k, i, 2, 'S' || (k * 10 + i) from sums where not stopped and held < 6 and has_short)
select o_orderkey, count(id)::bigint as n_ids, coalesce(string_agg(id, ',' order by i, o), '') as ids
from orders left join ids on k = o_orderkey group by o_orderkey""",
    "build_catalog": _BUILT_SQL,
    "build_catalog_ledger": f"with {_LEDGER_SQL} select file_name, id::varchar as isbn, status from ledger",
    "append_ledger": f"""
with {_LEDGER_SQL}
select file_name, id::varchar as isbn, status, 'first' as batch from ledger
union all
select file_name, id::varchar, case when status = 'skipped' then 'pending' else status end, 'second' from ledger""",
}
