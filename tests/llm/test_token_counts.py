"""Token counts against the library on whole texts."""

from __future__ import annotations

import random

import pytest
import sentencepiece

from tomeweave.llm import token_counts
from tomeweave.llm.common import table
from tomeweave.llm.vocabularies import Pieces, public_path, read

MODEL = public_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def frame(spark, texts):
    rows = [(doc, t, 1, "clash") for doc, t in texts]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, n_tokens INT, row STRING").repartition(3)


def test_query(spark, small, library):
    want = sorted(
        (r["doc_id"], len(r["text"].encode()), n := len(library.encode(r["text"])), n > 4096)
        for r in table(spark, small, "documents").collect()
    )
    assert sorted(tuple(r) for r in token_counts.query(spark, small).collect()) == want


def odd_texts(rng):
    letters = "ab é  \n日語,.;\U0001f600_1ñ\t"
    texts = [None, "", " ", "   ", "a", "</s><unk><s> x</s>", "▁ x ▁▁y", "\x00", "a" * 700, "ab" * 400, "日本語" * 200]
    texts += ["".join(rng.choices(letters, k=rng.randint(30, 400))) for _ in range(40)]
    texts += ["Some words, " * 60 + "▁" + " and more" * 50, "x " * 300, "=" * 500 + " end " + "-" * 500, " " * 900]
    return list(enumerate(texts)) + [(3, "again"), (None, "no id")]


@pytest.mark.parametrize("size, overlap", [(50, 8), (7, 2)])
def test_odd_texts_over_many_chunks(spark, library, size, overlap):
    """Some are aligned at once, some after wider overlaps, some only as a whole."""
    texts = odd_texts(random.Random(1))
    got = token_counts.count_tokens(frame(spark, texts), MODEL, size, overlap).collect()
    want = sorted(((d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in texts), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == want
    assert len({r["row"] for r in got}) == len(texts)


def test_overlaps_are_widened(spark, monkeypatch):
    widths = []
    cut = token_counts._cut
    monkeypatch.setattr(token_counts, "_cut", lambda size, overlap: widths.append(overlap) or cut(size, overlap))
    texts = [(1, "one two three four " * 20), (2, "a" * 300)]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame(spark, texts), MODEL, 50, 4).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert widths[0] == 4 and len(widths) > 1 and widths[-1] >= 300
    assert got == {d: len(library.encode(t)) for d, t in texts}


def test_neighbours_meet_at_the_same_proven_boundary():
    pieces, rng = read(Pieces, MODEL), random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgé日", k=rng.randint(1, 9))) for _ in range(600))
    found = [token_counts.spliced(pieces, *c[1:], 64) for c in token_counts.chunks(text, 200, 64)]
    assert len(found) > 10 and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert sum(n for _, _, n in found) == len(pieces.encode([text])[0])


def test_no_rows(spark):
    assert token_counts.count_tokens(frame(spark, []), MODEL).collect() == []
