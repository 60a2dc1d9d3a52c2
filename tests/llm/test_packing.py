"""Packing: every token exactly once, gapless windows, little padding."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tomeweave.llm import packing
from tomeweave.llm.common import table


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_vocabulary())


def check(rows, texts, tokenizer, window=2048):
    """Rows are whole; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_query(spark, small, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    assert check(packing.query(spark, small).collect(), texts, tokenizer) == 0


def test_odd_rows(spark, tokenizer):
    texts = {1: None, 2: "", 3: " ", 4: "word " * 5000, 5: "İstanbul ΟΔΟΣ <|endoftext|> x\x1cy don't 12ab a\xa0b \u0301", 6: "a.b, c.. d. e", 7: "ok"}
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in texts.items()], "doc_id LONG, text STRING, ids STRING, start INT")
    rows = packing.pack(df).selectExpr("*", "crc32(ids) ids_crc32").collect()
    assert check(rows, texts, tokenizer) == 0
    same = packing.pack(df.where("doc_id = 7").union(df.where("doc_id = 7"))).collect()
    assert sorted(r["length"] for r in same) == [2, 2] and all(r["doc_tokens"] == 2 for r in same)
    assert packing.pack(df.limit(0)).collect() == []


def test_levels_minimise_squares():
    rng = np.random.default_rng(7)
    packer = packing.Packer(32)
    for doc in range(400):
        rest = int(rng.integers(1, 32))
        before = packer.counts.copy()

        def squares(level):
            c = before.copy()
            if level:
                c[level] -= 1
            if level + rest < 32:
                c[level + rest] += 1
            return int((c * c).sum())

        allowed = [0, *(h for h in range(1, 33 - rest) if before[h])]
        assert squares(packer._level(rest)) == min(map(squares, allowed))
        list(packer.add(doc, b"\0" * 4 * rest))
        assert [len(packer.open.get(h, [])) for h in range(1, 32)] == packer.counts[1:32].tolist()


def test_encoder_equals_the_tokenizer(spark, small, tokenizer):
    texts = [r["text"] for r in table(spark, small, "documents").collect()]
    texts += ["Ünïcödé ÄÖÜ. É, x...y .a ,b", "a\u0301b E\u0301.", "''' it's 'S Σ", "A.B. C.D, \n", "日本語。 テスト, ok"]
    encode = packing.Encoder(packing.default_vocabulary())
    for text, ids in zip(texts, encode(texts)):
        assert ids == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_small_memory_gives_the_same_ids():
    """Words go in generations; those met again stay, and what is remembered is bounded."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghij"))
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 6))) for _ in range(60)) + ", the end." for _ in range(60)]
    small = packing.Encoder(packing.default_vocabulary(), 80_000)
    large = packing.Encoder(packing.default_vocabulary())
    learned = []
    learn = small._learn
    small._learn = lambda new: (learned.extend(new), learn(new))
    for text in texts:
        assert small([text]) == large([text])
        held = sum(packing.OVERHEAD + len(w) + len(x) for w, x in small.known.items())
        assert small.size == held and held < 80_000 // 2 + 15_000  # and the words of one call
    assert len(small.known) + len(small.older) < len(large.known) and large.older == {}
    assert learned.count("the") == 1 and "the" in small.known
