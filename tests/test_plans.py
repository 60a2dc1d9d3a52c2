"""What the plans must look like to hold on large and skewed inputs."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from tomeweave.operators import bayes, catalog, groups, labels, profile, stem, terms
from tomeweave.sources import workspace


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def scan(spark, small, name):
    return spark.read.parquet(f"{small}/{name}.parquet")


def test_per_document_work_needs_no_shuffle(spark, small):
    docs = scan(spark, small, "documents")
    for df in (terms.term_counts(docs, ["doc_id"]), profile.measure(docs), profile.document_stats(docs)):
        assert "Exchange" not in plan(df)


def test_term_counts_are_summed_before_the_shuffle(spark, small):
    text = plan(terms.document_frequency(terms.term_counts(scan(spark, small, "documents"), [])))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_columns_and_filters_reach_the_scan(spark, small):
    rows = scan(spark, small, "orders").select("o_orderkey", F.col("o_orderstatus").alias("genre"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        catalog.filter_equals(rows, "genre", "F").select("o_orderkey").explain("formatted")
    assert "EqualTo(o_orderstatus,F)" in out.getvalue()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in out.getvalue()


def test_only_fixed_rules_are_broadcast_by_hint(spark, small, no_broadcast, monkeypatch):
    tags = scan(spark, small, "events").select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("label"), F.lit(1).alias("weight")
    )
    text = plan(labels.consolidate(tags))
    assert text.count("BroadcastExchange") == 1 and text.count("Exchange hashpartitioning") == 1
    counts = terms.term_counts(scan(spark, small, "documents"), ["doc_id"])
    monkeypatch.setattr(workspace, "FEW", 0)
    weighted = plan(terms.tfidf(counts, terms.inverse_document_frequency(counts, scan(spark, small, "documents")), "doc_id"))
    assert "BroadcastExchange" not in weighted and "SortMergeJoin" in weighted


def test_exploded_tokens_are_never_built_into_a_table(spark, small):
    """Spark takes an exploded array for as small as its scan; the stored side is marked instead."""
    docs = scan(spark, small, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    counts = terms.term_counts(docs, ["doc_id"])
    model = bayes.fit(terms.term_counts(docs, ["label"]), docs)
    for df in (
        terms.tfidf(counts, terms.inverse_document_frequency(counts, docs), "doc_id"),
        bayes.score(model, counts, docs, "doc_id"),
        stem.stemmed_counts(counts, "doc_id"),
    ):
        text = plan(df)
        assert "BroadcastHashJoin" in text and not re.search(r"\[term[^\n]*Inner, BuildLeft", text)


def test_ranking_keeps_few_rows_per_task(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    text = plan(groups.top_n_per_group(df, ["g"], [F.desc("v")], 10))
    # Two rounds, each cut before and after its shuffle.
    assert text.count("WindowGroupLimit") == 4


def test_first_of_a_group_is_chosen_by_partial_aggregates(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    text = plan(groups.keep_first(df, ["g"], [F.col("v")]))
    assert "Window" not in text and "partial_min_by" in text


@pytest.fixture
def tiny_partitions(spark, no_broadcast, monkeypatch):
    """Sizes at which a few thousand rows count as skewed, and no stored table as small."""
    monkeypatch.setattr(workspace, "FEW", 0)
    names = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot_documents(spark):
    """A term that every document holds."""
    text = F.concat(F.lit("hot term"), (F.col("id") % 997).cast("string"))
    return spark.range(0, 20000, 1, 8).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"), text.alias("text")
    )


def test_a_hot_term_is_split_in_tfidf(spark, tiny_partitions):
    docs = hot_documents(spark)
    counts = terms.term_counts(docs, ["doc_id"])
    weighted = terms.tfidf(counts, terms.inverse_document_frequency(counts, docs), "doc_id")
    assert len(weighted.collect()) == 40000
    assert "skew=true" in plan(weighted)


def test_a_hot_term_is_split_in_bayes_scores(spark, tiny_partitions):
    docs = hot_documents(spark)
    model = bayes.fit(terms.term_counts(docs, ["label"]), docs)
    scored = bayes.score(model, terms.term_counts(docs, ["doc_id"]), docs, "doc_id")
    assert len(scored.collect()) == 20000
    assert "skew=true" in plan(scored)


def test_a_hot_candidate_is_split(spark, tiny_partitions):
    books = spark.range(0, 30000, 1, 8).select(
        F.col("id").cast("string").alias("file_name"),
        F.array(F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("id").cast("string"))).alias("ids"),
    )
    tagged = spark.range(1000).select(F.col("id").cast("string").alias("isbn")).union(
        spark.createDataFrame([("x",)], "isbn string")
    )
    resolved = catalog.resolve_candidates(books, tagged.filter("isbn = 'none'"), tagged)
    assert sum(r["status"] == "duplicate" for r in resolved.collect()) == 9999
    assert "skew=true" in plan(resolved)


def test_shared_candidates_are_not_a_join_key(spark, no_broadcast):
    books = spark.range(100).select(F.col("id").alias("file_name"), F.array(F.lit("x")).alias("ids"))
    one = spark.createDataFrame([("x",)], "isbn string")
    resolved = catalog.resolve_candidates(books, one.filter("isbn = 'y'"), one)
    counts = {r["status"]: r["count"] for r in resolved.groupBy("status").count().collect()}
    assert counts == {"processed": 1, "duplicate": 99}
    assert "Window" not in plan(resolved)
