"""Chat formatting: exact round trips and the mask of every example."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomeweave.llm import chat

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, example STRING, e INT"
PIECES = st.lists(st.sampled_from(["</s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_sep|>", "<", "[", "\\", "s>", "x", "é😀"]), max_size=8)


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(2)
    got = chat.read_back(chat.expand(df)).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == expected(rows)


def test_defined_cases(spark):
    check(spark, [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", "more"),
        (2, 0, "assistant", None), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (2, None, None, "first"),
        (None, 0, "user", "<|im_start|>assistant<|im_sep|>no<|im_end|>"), (3, 5, "sys\ntem", ""), (4, 0, "<|im_sep|>", "\\</s>\\"),
        (5, 0, "assistant", "é😀" * 20_000),
    ])
    check(spark, [])


def test_escape_round_trip(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(PIECES.map("".join), min_size=30, max_size=60))
    def run(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", chat.escape(F.col("t")).alias("e"))
        for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
            assert r["u"] == r["t"]
            assert not any(c in r["e"] for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_sep|>", "<|im_start|>"))

    run()


def test_examples(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "bb"), (1, 2, "user", "c"), (1, 3, "assistant", "<s>"), (1, 4, "user", "d")]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    out = sorted(chat.expand(df).collect(), key=lambda r: r["example"])
    assert [r["n_turns"] for r in out] == [2, 4, 5] and [r["closing"] for r in out] == [False, False, True]
    assert [r["text"][r["loss_start"] : r["loss_start"] + r["loss_length"]] for r in out] == ["bb", "<\\s>", ""]
    assert all(out[2]["text"].startswith(r["text"]) for r in out)
    assert out[0]["text"] == "<|im_start|>user<|im_sep|>a<|im_end|><|im_start|>assistant<|im_sep|>bb<|im_end|>"
