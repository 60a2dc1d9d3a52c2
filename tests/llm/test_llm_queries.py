"""Queries that SQL can express, against DuckDB on the same tables; and the registry's shape."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tomeweave.llm.registry import ORACLES, QUERIES

NATIVE = {"op3_prefix_target_chat", "op7_licence_labels", "op9_segment_line_dedup"}


def test_entry_hands_out_every_query():
    names = set(__spark_entry__.queries())
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= names
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == columns
    want = Counter(tuple(r[theirs.index(c)] for c in columns) for r in cursor.fetchall())
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(NATIVE))
def test_native_plans_hold_no_python(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan
