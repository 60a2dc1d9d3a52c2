"""Scans, sinks, jobs over directories, and incremental ingestion."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tomeweave.operators import catalog as cat
from tomeweave.plans import jobs
from tomeweave.sources import file_stream, files, sinks, workspace
from tomeweave.streaming import ingest


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode("latin-1"))


def book(title, author="A", language="English", body="Body."):
    return f"Title: {title}\nAuthor: {author}\nLanguage: {language}\n*** START ***\n{body}\n*** END ***\nlicence\n"


def test_labelled_corpus(spark, tmp_path):
    put(tmp_path, "Poetry/été 100%%%x.txt", "vers é")
    put(tmp_path, "History/a.txt", "old")
    put(tmp_path, "Cooking/b.txt", "soup")
    got = {(r["label"], r["text"]) for r in files.read_labelled_corpus(spark, str(tmp_path)).collect()}
    assert got == {("Poetry", "vers é"), ("History", "old")}
    everything = files.read_labelled_corpus(spark, str(tmp_path), None, None)
    assert {r["label"] for r in everything.collect()} == {"Poetry", "History", "Cooking"}


def test_listing_and_whole_text(spark, tmp_path):
    put(tmp_path, "d/a.txt", "x\ny\n")
    put(tmp_path, "d/b%%%c.txt", "zz")
    listed = files.list_files(spark, str(tmp_path)).select("file_name", "length").collect()
    assert {tuple(r) for r in listed} == {("a.txt", 4), ("b%%%c.txt", 2)}
    texts = files.read_text_files(spark, str(tmp_path / "d")).select("text").collect()
    assert {r["text"] for r in texts} == {"x\ny\n", "zz"}


@pytest.fixture
def mirror(tmp_path):
    root = tmp_path / "mirror"
    put(root, "1/1.txt", book("One/1", body="First."))
    put(root, "1/1-8.txt", book("One in another charset"))
    put(root, "2/2.txt", book("Deux", language="French"))
    put(root, "3/0readme.txt", "readme")
    put(root, "3/3.txt", book("Lost with its readme"))
    put(root, "4/4.txt", book("Four", "Élan"))
    put(root, "4/old/0.txt", book("Nested"))
    put(root, "5/5.txt", book("Not listed"))
    listing = tmp_path / "dirs.txt"
    listing.write_text("/1\n/2\n/missing\n/3\n/4\n")
    return root, listing


def test_build_corpus(spark, mirror):
    root, listing = mirror
    got = jobs.build_corpus(spark, str(root), str(listing)).select("title", "author", "name", "text").collect()
    # "1-8.txt" sorts before "1.txt".
    assert {tuple(r) for r in got} == {
        ("One in another charset", "A", "One in another charset%%%A.txt", "Body."),
        ("Four", "Élan", "Four%%%Élan.txt", "Body."),
    }
    resumed = jobs.build_corpus(spark, str(root), str(listing), marker="/3").collect()
    assert [r["title"] for r in resumed] == ["Four"]
    assert jobs.build_corpus(spark, str(root), str(listing), marker="/none").count() == 0


def test_directory_list_skips_what_is_no_directory(spark, mirror):
    root, listing = mirror
    listed = files.read_directory_list(spark, str(listing), str(root))
    held = files.list_files(spark, str(root)).select(F.regexp_replace("dir", "^file:/*", "/").alias("dir"))
    got = files.existing_directories(listed, held).orderBy("pos").collect()
    assert [r["entry"] for r in got] == ["/1", "/2", "/3", "/4"]


def test_sanitize_corpus(spark, tmp_path):
    put(tmp_path, "a.txt", "*** START\r\nété\r\n*** END\r\n".encode())
    put(tmp_path, "b.txt", b"caf\xe9")
    raw = files.read_raw_files(spark, str(tmp_path))
    got = {(r["charset"], r["text"]) for r in jobs.sanitize_corpus(raw).collect()}
    assert got == {("UTF-8", "été"), ("ISO-8859-1", "café")}
    assert jobs.sanitize_corpus(raw, ["UTF-8"]).count() == 1
    sinks.rewrite_texts(jobs.sanitize_corpus(raw), str(tmp_path / "clean"), ("charset",))
    kept = spark.read.parquet(str(tmp_path / "clean"))
    assert {(r["charset"], r["text"]) for r in kept.collect()} == got
    assert {r["content"] for r in files.read_raw_files(spark, str(tmp_path / "b.txt")).collect()} == {b"caf\xe9"}


def test_ensure_append_upsert_write(spark, tmp_path):
    path = str(tmp_path / "catalog")
    assert sinks.ensure_table(spark, path, cat.LISTING_SCHEMA).count() == 0
    entry = ("t", "a", "g", "f", "d", "i")
    entries = spark.createDataFrame([(*entry, "n1"), (*entry, "n2")], cat.LISTING_SCHEMA + ", name STRING")
    sinks.append_existing(entries, spark.createDataFrame([("n1",)], "name string"), path)
    assert sinks.ensure_table(spark, path, cat.LISTING_SCHEMA).count() == 1
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2)], "k string, v int")
    sinks.write_upsert(old, new, ["k"], str(tmp_path / "v2"))
    assert [tuple(r) for r in files.read_catalog(spark, str(tmp_path / "v2")).collect()] == [("a", 2)]
    texts = spark.createDataFrame(
        [("n", "x", 1, "first"), ("n", "x", 2, "last"), ("n", "x", 2, "last"), (None, "x", 1, "nameless")],
        "name string, label string, i int, text string",
    )
    sinks.write_texts(texts, str(tmp_path / "texts"), [F.col("i")])
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "texts")).collect()) == ["last", "nameless"]
    proba = spark.createDataFrame([(1, "x", 0.5)], "k int, label string, probability double")
    sinks.write_probabilities(proba, str(tmp_path / "p"), "json")
    assert spark.read.json(str(tmp_path / "p")).count() == 1


def test_build_catalog_status(spark):
    import json

    def response(*ids):
        item = {"volumeInfo": {"industryIdentifiers": [{"type": "ISBN_10", "identifier": i} for i in ids]}}
        return json.dumps({"items": [item]})

    line = '<a class="actionLinkLite bookPageGenreLink" href="/genres/{}">\n<a title="{} people">\n'
    page = '<a href="/work/shelves/1">\n' + line.format("fiction", 9) + line.format("war", 4)
    books = [(n,) for n in ("A%%%x.txt", "B%%%x.txt", "C%%%x.txt", "$$$D%%%x.txt", ".DS_Store", "E%%%x.txt", "F%%%x.txt")]
    update = jobs.build_catalog(
        spark.createDataFrame(books, "file_name string"),
        spark.createDataFrame(
            [("A", "x", response("1")), ("B", "x", response("1")), ("C", "x", response("2")), ("E", "x", response("9"))],
            "title string, author string, body string",
        ),
        spark.createDataFrame([("b/book/isbn/1", page), ("b/book/isbn/2", "none")], "url string, html string"),
        spark.createDataFrame([("9",)], "isbn string"),
        "b",
    )
    ledger = {r["file_name"][0]: r["status"] for r in update.ledger.collect()}
    assert ledger == {"A": "processed", "B": "duplicate", "C": "skipped", "E": "duplicate", "F": "skipped"}
    row = update.rows.first()
    assert (row["isbn"], row["title"], row["gtype"]) == ("1", "A", "fiction")
    assert row["genres_scraped"] == {"fiction": 9, "war": 4} and row["genres_mapped"] == {"historical-fiction": 4}


def _buckets(path):
    return {p.parent.name: p.name for p in path.rglob("*.parquet")}


def test_upsert_in_place_touches_only_buckets_with_new_keys(spark, tmp_path):
    path = tmp_path / "table"
    old = [(f"k{i}", i) for i in range(200)] + [(None, -1), ("k3", -5)]
    sinks.upsert_in_place(spark.createDataFrame(old, "k string, v int"), ["k"], str(path), buckets=16)
    before = _buckets(path)
    want = {k: v for k, v in old} | {"k3": 3}
    assert dict(map(tuple, spark.read.parquet(str(path)).select("k", "v").collect())) == want and len(before) == 16
    new = spark.createDataFrame([("k7", 70), ("k7", 71), ("new", 1), (None, -2)], "k string, v int")
    sinks.upsert_in_place(new, ["k"], str(path), [F.col("v")])
    after = _buckets(path)
    rows = [tuple(r) for r in spark.read.parquet(str(path)).select("k", "v").collect()]
    assert dict(rows) == want | {"k7": 71, "new": 1, None: -2} and len(rows) == len(dict(rows)) == 202
    changed = {b for b in before if after[b] != before[b]}
    assert after.keys() == before.keys() and 1 <= len(changed) <= 3
    sinks.upsert_in_place(new.limit(0), ["k"], str(path))
    assert _buckets(path) == after


def _ingest(spark, tmp_path):
    rows = ingest.stream_raw_files(spark, str(tmp_path / "in"), str(tmp_path / "log"))
    query = ingest.ingest_new(rows, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    got = spark.read.schema(rows.schema).parquet(str(tmp_path / "out"))
    return sorted(tuple(r) for r in got.select("label", "file_name", "charset", "text").collect())


def test_ingest_reads_each_file_once(spark, tmp_path):
    put(tmp_path / "in", "Poetry/a.txt", "one")
    for _ in range(2):
        assert _ingest(spark, tmp_path) == [("Poetry", "a.txt", "ascii", "one")]
    put(tmp_path / "in", "History/b.txt", b"\xe9t\xe9")
    assert _ingest(spark, tmp_path) == [("History", "b.txt", "ISO-8859-1", "été"), ("Poetry", "a.txt", "ascii", "one")]


def test_ingest_sees_files_of_all_names_sizes_and_times(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_stream, "BYTES", 8)  # several tasks
    names = ["_x.txt", ".y", "a b %20é.txt", "empty", "_dir/z", ".dir/deep/w"]
    put(tmp_path / "in", "first", "1")
    _ingest(spark, tmp_path)
    for n in names:
        put(tmp_path / "in", f"p/{n}", "" if n == "empty" else f"in {n}".encode())
        os.utime(tmp_path / "in" / "p" / n, (1, 1))  # older than what was read before
    got = _ingest(spark, tmp_path)
    want = {(n.rpartition("/")[2], "" if n == "empty" else f"in {n}") for n in names} | {("first", "1")}
    assert {(f, t) for _, f, _, t in got} == want and len(got) == 7


def test_a_batch_run_again_reads_the_files_it_was_planned_with(spark, tmp_path):
    """What was listed before a failure is neither lost nor read twice."""
    put(tmp_path / "in", "p/a", "a")
    source = file_stream.every_file_source()({"root": str(tmp_path / "in"), "log": str(tmp_path / "log")})
    reader = source.streamReader(None)
    assert reader.latestOffset() == {"manifest": 0} == reader.latestOffset()
    put(tmp_path / "in", "p/b", "b")  # arrives between planning and failure
    again = source.streamReader(None)
    (part,) = again.partitions({"manifest": -1}, {"manifest": 0})
    assert [c for _, c in again.read(part)] == [b"a"]
    assert again.latestOffset() == {"manifest": 1}
    (part,) = again.partitions({"manifest": 0}, {"manifest": 1})
    assert [c for _, c in again.read(part)] == [b"b"]
    assert source.streamReader(None).initialOffset() == {"manifest": -1}


def test_no_files(spark, tmp_path):
    assert _ingest(spark, tmp_path / "none") == []


def test_first_writer_wins_across_batches_and_reruns(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, v int"

    def run():
        rows = ingest.stream_table(spark, source, spark.createDataFrame([], schema).schema)
        ingest.ingest_first_per_key(rows, target, str(tmp_path / "check"), ["k"], [F.col("v")]).awaitTermination()
        return sorted((r["k"], r["v"]) for r in spark.read.parquet(target).collect())

    spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], schema).write.mode("append").parquet(source)
    assert run() == [("a", 1), ("b", 5)]
    second = spark.createDataFrame([("a", 0), ("c", 7)], schema)
    second.write.mode("append").parquet(source)
    assert run() == [("a", 1), ("b", 5), ("c", 7)]
    # The second batch again, as after a failure: the table stays as it is.
    ingest._first_writer(target, ["k"], [F.col("v")])(second, 1)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(target).collect()) == [("a", 1), ("b", 5), ("c", 7)]


class _Session:
    """Stands in for a session with a given master and configured folder."""

    def __init__(self, spark, master, folder):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = type(
            "Context",
            (),
            {"master": master, "applicationId": "app", "getCheckpointDir": staticmethod(lambda: None)},
        )


def test_shared_folder_is_the_configured_one(spark):
    assert workspace.fresh_path(_Session(spark, "yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/app/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.fresh_path(_Session(spark, "yarn", None), "x")
    assert workspace.materialise(spark.range(3), "ids").count() == 3


def test_spread_is_the_sessions_choice(spark):
    rows = spark.range(0, 100, 1, 1)
    assert workspace.spread(rows, "id").rdd.getNumPartitions() == 4
    chosen = spark.conf.get(workspace.SPREAD)
    spark.conf.unset(workspace.SPREAD)
    assert workspace.spread(rows, "id") is rows
    spark.conf.set(workspace.SPREAD, chosen)


def test_a_directory_is_listed_in_parts_of_bounded_size(tmp_path):
    """However many files a directory holds, a task has but a part of them in memory."""
    (tmp_path / "sub").mkdir()
    for i in range(23):
        (tmp_path / f"{'_' if i % 2 else '.'}f{i}").write_bytes(b"x" * i)
    (tmp_path / "gone").symlink_to(tmp_path / "nothing")
    parts = list(files.listing_in_tasks(at_once=10)(f"file:{tmp_path}"))
    assert [p.num_rows for p in parts] == [10, 10, 5]
    found = {r["path"].rpartition("/")[2]: r for p in parts for r in p.to_pylist()}
    assert found["sub"]["directory"] and found["sub"]["length"] is None
    assert not found["gone"]["directory"] and found["gone"]["length"] is None
    for i in range(23):
        name = f"{'_' if i % 2 else '.'}f{i}"
        at = found[name]["modificationTime"].timestamp()
        assert found[name]["length"] == i and at == pytest.approx((tmp_path / name).stat().st_mtime, abs=1e-3)
    single = list(files.listing_in_tasks()(f"file:{tmp_path}/_f1"))
    assert [r["length"] for p in single for r in p.to_pylist()] == [1]
    (tmp_path / "empty").mkdir()
    assert list(files.listing_in_tasks()(f"file:{tmp_path}/empty")) == []
