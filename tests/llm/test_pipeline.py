"""The pipeline's stages one by one, each judged on its own input."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from tomeweave.llm import mixing, toxicity
from tomeweave.sources.workspace import materialise

from test_line_dedup import brute as without_repeats
from test_shingle_join import brute as joined


@pytest.fixture(scope="module")
def tables(spark, small):
    """What every stage was given, and the result."""
    out = [spark.read.parquet(f"{small}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], small), "stage"))
    return out


def test_order_and_columns(tables):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    assert all(t.schema == tables[0].schema for t in tables[1:-1])


def test_toxic_documents_go(spark, small, tables):
    toxic = {r["doc_id"] for r in toxicity.query(spark, small).collect() if r["toxic"]}
    given, kept = ({r["doc_id"] for r in t.collect()} for t in tables[:2])
    assert kept == given - toxic and toxic


def test_repeated_lines_go(tables):
    given = sorted((r["doc_id"], r["text"]) for r in tables[1].collect())
    want = {d: left for (d, text), left in zip(given, without_repeats(given, 20)) if left.strip() or not text.strip()}
    rows = tables[2].collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_one_near_copy_stays(tables):
    given = [(r["doc_id"], r["text"]) for r in tables[2].collect()]
    want = {d for (_, d), _, c in joined(given) if d == c}
    assert {r["doc_id"] for r in tables[3].collect()} == want


def test_mix_takes_effect(tables):
    want = Counter()
    for r in mixing.mix_plan(tables[3]).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in tables[4].collect()) == +want


def test_pieces_hold_every_mixed_document(tables):
    given = Counter(r["doc_id"] for r in tables[4].collect())
    tokens, size = Counter(), {}
    for r in tables[5].collect():
        tokens[r["doc_id"]] += r["length"]
        size[r["doc_id"]] = r["doc_tokens"]
    assert tokens == {d: n * size[d] for d, n in given.items()}


def test_run_is_the_stages(spark, small, tables):
    rows = corpus_pipeline.run(spark, small)
    assert rows.columns == tables[5].columns
    assert rows.groupBy("doc_id").sum("length").exceptAll(tables[5].groupBy("doc_id").sum("length")).count() == 0


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, small), "empty")
    assert docs.count() == 0
