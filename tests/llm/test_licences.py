"""Licence labels against a plain scan of the words."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from tomeweave.llm import licences
from tomeweave.llm.common import table


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def brute(texts):
    """The result for texts by id, without an index."""
    words = {i: words_of(t) for i, t in texts.items()}
    vocabulary = {w for _, t, _ in licences.TEMPLATES for w in t.split()}
    frequency = Counter(w for ws in words.values() for w in set(ws) & vocabulary)
    out = {}
    for i, ws in words.items():
        found = [(a, label) for p, label in licences.PHRASES.items() for a in places(ws, p)]
        base = sorted({label for _, label in found})
        extra, score = set(), 0.0
        for label, template, key in licences.TEMPLATES:
            t = template.split()
            rare = sorted(set(t), key=lambda w: (frequency[w], w))[: licences.INDEXED]
            at = [k for k, w in enumerate(t) if w in rare]
            offset = places(t, key)[0]
            for a in places(ws, key):
                agree = sum(0 <= a - offset + k < len(ws) and ws[a - offset + k] == t[k] for k in at)
                if agree >= licences.AGREE:
                    extra.add(label)
                    score = max(score, agree / len(at))
        starts = [a for a, _ in found]
        out[i] = (
            len(ws), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(base), ",".join(sorted({*base, *extra})), 1.0 if found else score,
        )
    return out


def result(rows):
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return {r["doc_id"]: tuple(r[n] for n in names) for r in rows}


def check(got, want):
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:-1] == want[i][:-1], i
        assert got[i][-1] == pytest.approx(want[i][-1])


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    check(result(licences.query(spark, small).collect()), brute(texts))


def test_defined_cases(spark):
    texts = {
        1: None, 2: "", 3: " -- ", 4: "the MIT license", 5: "The mit license the mit license, the MIT License!", 6: "cc by nc cc-by-nc CC_BY_NC 4.0",
        7: "Apache License, Version 2.0 and the MIT License", 8: "apache license version 2x", 9: "the mit licensed",
        10: "Permission is hereby granted, free of charge, to any person obtaining a copy of it",
        11: "x " * 30_000 + "This work is licensed under the GNU General Public License, version 3.",
        12: "either version 3 general public of the license gnu free", 13: "Kİ worK is the mıt license", 14: "éthe mit license",
        15: "Licensed under the Apache License, Version 2.0. Redistribution and use in source and binary forms, with or without modification, are permitted",
        None: "the mit license",
    }
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id LONG, text STRING, words STRING, score INT")
    got = result(licences.scan(df.repartition(3)).collect())
    check(got, brute(texts))
    assert got[15][5] == "apache-2,bsd" and got[11][5] == "gpl-3" and got[12][5] == ""
    twice = licences.scan(df.union(df)).collect()
    assert len(twice) == 2 * len(texts) and result(twice).keys() == got.keys()
    assert licences.scan(df.limit(0)).collect() == []
