r"""Licence scan by a positional index of rare words.

The words of short licence templates are indexed by position, of each template only those of the
highest inverse document frequency, counted over all documents. A file's words that are among them
are looked up. Each occurrence votes, through the postings, for the place where a template would have to start; a template is
found where at least two of those words agree on that place and the template's mandatory key
phrase stands at its relative position.

Words are runs of digits, letters a-z (A-Z lower-cased) and everything beyond ASCII, numbered from
0. All work is on columns; only votes are shuffled, and templates bound what is collected.

Defined results: NULL and empty texts have no words and no labels. A row's labels come from its
own text, so repeated rows give equal rows, and rows that share an id do not mix. Overlapping
places all count. Of equal frequencies the alphabetically first word is indexed. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.common import table
from tomeweave.sources.workspace import materialise

# Phrases that carry a licence by themselves, and their labels.
PHRASES = {
    "the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices of well-known licences, of 63 words at most. (label, template, mandatory key phrase)
TEMPLATES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "licensed under the terms of the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3", "either version 3"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2", "either version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)

# How many words of a template are indexed, and how many must agree on a place.
INDEXED, AGREE = 4, 2


def normal(text: Column) -> Column:
    """The words, each between single spaces; upper case is kept. A text without words is blank."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def lowered(words: Column) -> Column:
    """ASCII letters in lower case; the two other characters that turn into them are put aside."""
    odd = words.contains("\u212a") | words.contains("\u0130")
    return F.lower(F.when(odd, F.regexp_replace(words, "[\u212a\u0130]", "\u00df")).otherwise(words))


def counted(spaced: Column) -> Column:
    """Number of words of a normal text or of a part of one."""
    bare = F.trim(spaced)
    spaces = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit("")))
    return F.when(F.length(bare) == 0, 0).otherwise(spaces + 1).cast("long")


def _starting_at(words: Column, phrases) -> Column:
    """The text parted before each place of a phrase."""
    any_of = "|".join(re.escape(p) for p in sorted(phrases))
    return F.split(words, rf"(?i) (?=(?:{any_of}) )")


def _label_of(part: Column, phrases: Mapping[str, str]) -> Column:
    """The labels of the phrases a part starts with."""
    low = F.concat(F.lower(F.substring(part, 1, max(map(len, phrases)) + 1)), F.lit(" "))
    return F.filter(
        F.array(*[F.when(low.startswith(p + " "), F.lit(label)) for p, label in phrases.items()]),
        lambda x: x.isNotNull(),
    )


def scan(docs: DataFrame, templates=TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """One row per document: word count, places of the phrases, and labels with a score.

    ``score`` is 1 where a phrase stands, else the best share of a template's indexed places that
    agree on its start.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    known = F.array(*map(F.lit, vocabulary))
    texts = docs.select("doc_id", normal(F.col("text")).alias("words"))

    held = texts.select(F.explode(F.array_intersect(F.split(lowered(F.col("words")), " "), known)).alias("word"))
    frequency = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    rarest = [
        sorted(set(t.split()), key=lambda w: (frequency.get(w, 0), w))[:INDEXED] for _, t, _ in templates
    ]
    indexed = F.array(*map(F.lit, sorted({w for words in rarest for w in words})))

    keys = sorted({key for _, _, key in templates})
    parts = _starting_at(F.col("words"), phrases)
    key_parts = _starting_at(F.col("words"), keys)

    def mentions(some) -> Column:
        return F.col("words").rlike("(?i) (?:" + "|".join(map(re.escape, some)) + ") ")

    rows = materialise(
        texts.select(
            "doc_id",
            F.xxhash64("words").alias("h"),
            counted(F.col("words")).alias("n_words"),
            F.when(mentions(phrases), parts).alias("parts"),
            F.when(mentions(keys), key_parts).alias("key_parts"),
            F.split(F.trim(lowered(F.col("words"))), " ").alias("low"),
        )
        .withColumn("rare", F.array_intersect(indexed, "low"))
        .select(
            "doc_id",
            "h",
            "n_words",
            F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts") - 1).cast("long").alias("n_base"),
            counted(F.get("parts", F.lit(0))).alias("first_word"),
            (F.col("n_words") - counted(F.element_at("parts", -1))).alias("last_word"),
            F.array_sort(
                F.array_distinct(F.flatten(F.transform(F.slice("parts", F.lit(2), F.size("parts")), lambda p: _label_of(p, phrases))))
            ).alias("base"),
            F.transform(
                "key_parts", lambda p: F.struct(counted(p).alias("n"), _label_of(p, {k: k for k in keys}).alias("keys"))
            ).alias("key_parts"),
            F.when(
                F.size("rare") >= AGREE,
                F.filter(
                    F.transform("low", lambda w, i: F.struct(i.alias("at"), w.alias("word"))),
                    lambda x: F.array_contains("rare", x["word"]),
                ),
            ).alias("found"),
        ),
        "licence-words",
    )

    postings = [
        (w, number, at)
        for number, (_, t, _) in enumerate(templates)
        for at, w in enumerate(t.split())
        if w in rarest[number]
    ]
    index = F.broadcast(_literal(spark, postings, "word", "template", "at"))
    votes = (
        rows.select("doc_id", "h", F.explode("found").alias("f"))
        .join(index.alias("i"), F.col("f.word") == F.col("i.word"))
        .select(
            "doc_id", "h", "template", (F.col("f.at") - F.col("i.at")).alias("start"),
            F.expr("shiftleft(1L, i.at)").alias("agrees"),
        )
    )
    # The first part of a text starts with no key phrase, any other with its own.
    starts = rows.select("doc_id", "h", F.posexplode("key_parts").alias("part", "p")).where("part > 0")
    before = rows.where("key_parts IS NOT NULL").select(
        "doc_id",
        "h",
        F.posexplode(
            F.aggregate(
                "key_parts",
                F.array(F.lit(0).cast("long")),
                lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + p["n"]),
            )
        ).alias("part", "word_at"),
    )
    key_rows = _literal(
        spark, [(key, n, _find(t, key)) for n, (_, t, key) in enumerate(templates)], "key", "template", "at"
    )
    same = [F.col("s.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("s.h") == F.col("b.h"), F.col("s.part") == F.col("b.part")]
    verified = (
        starts.alias("s").join(before.alias("b"), same)
        .select("s.doc_id", "s.h", "b.word_at", F.explode("s.p.keys").alias("key"))
        .join(F.broadcast(key_rows), "key")
        .select("doc_id", "h", "template", (F.col("word_at") - F.col("at")).cast("int").alias("start"))
    )
    places = F.array(*[F.lit(sum(n == number for _, n, _ in postings)) for number in range(len(templates))])
    labels = F.array(*[F.lit(label) for label, _, _ in templates])
    ballots = votes.select("*", F.lit(False).alias("key")).unionByName(
        verified.select("*", F.lit(0).cast("long").alias("agrees"), F.lit(True).alias("key"))
    )
    found = (
        ballots.groupBy("doc_id", "h", "template", "start")
        .agg(F.bit_count(F.bit_or("agrees")).alias("agree"), F.max("key").alias("verified"))
        .where(F.col("verified") & (F.col("agree") >= AGREE))
        .select(
            "doc_id", "h", F.get(labels, F.col("template")).alias("label"),
            (F.col("agree") / F.get(places, F.col("template"))).alias("share"),
        )
        .groupBy("doc_id", "h")
        .agg(F.collect_set("label").alias("extra"), F.max("share").alias("share"))
    )
    own = F.coalesce(F.col("base"), F.array().cast("array<string>"))
    extra = F.coalesce(F.col("extra"), F.array().cast("array<string>"))
    return (
        rows.alias("r")
        .join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.h") == F.col("f.h")), "left")
        .select(
            "r.doc_id", "n_words", "n_base", "first_word", "last_word",
            F.array_join(own, ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(own, extra)), ",").alias("labels"),
            F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.col("share"), F.lit(0.0))).alias("score"),
        )
    )


def _literal(spark, rows: list[tuple], *names: str) -> DataFrame:
    """A table of a few fixed rows."""
    structs = [F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _find(template: str, key: str) -> int:
    """The word of the template that its key phrase starts at."""
    return len(template[: f" {template} ".index(f" {key} ")].split())


def query(spark, folder: str) -> DataFrame:
    """Contract ``op7``: every document's licence labels."""
    return scan(table(spark, folder, "documents"))
