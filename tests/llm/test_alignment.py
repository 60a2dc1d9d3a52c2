"""Aligned tokens against whole texts read by the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import string
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tomeweave.llm import alignment
from tomeweave.llm.alignment import Fragment
from tomeweave.llm.common import table
from tomeweave.llm.vocabularies import ByteBpe, Pieces, _letters, public_path

A, B = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
ODD = {
    1: None, 2: "", 3: " ", 4: "a", 5: "two  blanks \n\n and\ttabs ", 6: "▁ is not a blank", 7: "<|endoftext|> </s><unk> <s>",
    8: "日本語。 テスト\u3000ok é́ \U0001f600\U0001f600 x y \u180e z \x1c q", 9: " lead", 10: "It's John's, isn't it?!! (yes)...",
    11: "Ünïcödé: ½ ² ³% #1 a_b, a_. don''t", 12: "naïve,word.word ,x . y\n", 13: "x" * 300 + " " + "y " * 50, 14: "\x00 nul\x00", 15: "\r\n a\r\nb;\r",
}


def brute(texts: dict) -> dict:
    """``doc: n_a, n_b, n_groups, n_links, n_best, count_sum, digest``."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters, names = _letters(), {i: w for w, i in one.get_vocab().items()}

    def piece(i):
        return bytes([int(two.id_to_piece(i)[3:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()

    read = {}
    for doc, text in texts.items():
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a, bytes_b = [bytes(letters[c] for c in names[i]) for i in a], [piece(i) for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            read[doc] = None
            continue
        ends = [dict(zip(np.cumsum([len(x) for x in t]).tolist(), range(1, len(t) + 1))) for t in (bytes_a, bytes_b)]
        cuts = sorted(ends[0].keys() & ends[1].keys())
        groups, i, j = [], 0, 0
        for c in cuts:
            groups.append((a[i : ends[0][c]], b[j : ends[1][c]]))
            i, j = ends[0][c], ends[1][c]
        read[doc] = (a, b, groups, [(x[-1], y[-1]) for x, y in groups])
    counts = Counter(p for r in read.values() if r for p in r[3])
    best: dict = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = {}
    for doc, r in read.items():
        if r is None:
            out[doc] = (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, groups, links = r
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[doc] = (len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest())
    return out


def found(rows) -> list:
    fields = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(((r["doc_id"], *(r[c] for c in fields)) for r in rows), key=str)


def same(rows, texts):
    return found(rows) == sorted(((doc, *v) for doc, v in brute(texts).items()), key=str)


def frame(spark, texts):
    return spark.createDataFrame(
        [(doc, t, 1, "clash", 2) for doc, t in texts.items()], "doc_id LONG, text STRING, row INT, pair STRING, n_a INT"
    ).repartition(3)


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    assert same(alignment.query(spark, small).collect(), texts)


@pytest.mark.parametrize("size", [65_536, 40, 3])
def test_odd_texts_in_ranges_of_any_size(spark, size, monkeypatch):
    """Ranges end inside words, inside characters and in texts that are not given back."""
    monkeypatch.setattr(alignment, "FAN", 3)
    texts = ODD | {20: "One two, three four five. " * 60, 21: "日本語テスト" * 40, 22: "abc ▁ def " * 20}
    assert same(alignment.align(frame(spark, texts), A, B, size).collect(), texts)


def test_repeated_rows_are_documents_each(spark):
    df = frame(spark, {1: "one two", 2: "one two three"})
    rows = alignment.align(df.union(df), A, B).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [1, 1, 2, 2]
    assert len({r["row"] for r in rows}) == 4 and {r["count_sum"] for r in rows if r["doc_id"] == 1} == {2 * 4}
    assert alignment.align(df.limit(0), A, B).collect() == []


def test_fragments_compose_in_any_order():
    rng = random.Random(1)
    for _ in range(200):
        ends = [np.array(sorted(rng.sample(range(1, 61), rng.randint(0, 30)) + [61])) for _ in range(2)]
        names = [[str(rng.randint(0, 99)).encode() for _ in e] for e in ends]
        whole = alignment.of_tokens(names[0], ends[0], names[1], ends[1])
        stops = sorted(rng.sample(range(61), rng.randint(1, 6))) + [61]
        parts = []
        for low, high in zip([0, *stops], stops):
            inside = [(e > low) & (e <= high) for e in ends]
            kept = [[n for n, k in zip(ns, i) if k] for ns, i in zip(names, inside)]
            parts.append(alignment.of_tokens(kept[0], ends[0][inside[0]], kept[1], ends[1][inside[1]]))
        assert any(p.head_a or p.head_b for p in parts)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts[0] == whole == Fragment() + whole == whole + Fragment()


def test_ranges_cover_a_text_once():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab é\n  日,") for _ in range(rng.randint(1, 120)))
        size, at, data = rng.randint(1, 30), 0, (" " + text).encode()
        for words, base, low, high in alignment.ranges(text, size):
            assert low == at < high and base <= low
            held = (" " + words).encode()
            assert data[base : base + len(held)] == held and base + len(held) >= high
            at = high
        assert at == len(data)


def test_words_are_forgotten(monkeypatch):
    """A small memory gives the same answers."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices(string.ascii_letters + ".,", k=5)) for _ in range(40)) for _ in range(30)]
    small, large = alignment.Reader(A, B, 2000), alignment.Reader(A, B)
    for reader in (small, large):
        reader.out = []
        for t in texts:
            (words,), at = reader.words([t])
            reader.out += [(ok, n, m, g, links.tolist()) for ok, n, m, g, links in reader.whole([len(words)], at)]
    assert small.out == large.out and len(small.groups) < len(large.groups) / 3


def test_no_token_lies_over_the_blank_between_words():
    assert ByteBpe(A).parted and Pieces(B).parted
