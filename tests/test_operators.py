"""Relational operators against hand-worked cases and brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tomeweave import vocab
from tomeweave.functions.text import hash_bucket
from tomeweave.operators import bayes, catalog, evaluate, extract, groups, labels, profile, terms
from tomeweave.sources.workspace import materialise


def rows(df):
    return sorted(tuple(r) for r in df.collect())


ODYSSEY = {
    "adventure": 613, "poetry": 2880, "mythology": 1557, "epic": 412, "read-for-school": 492,
    "fiction": 3081, "literature": 1051, "school": 1118, "classics": 12244, "fantasy": 1077,
}
SHADES = {
    "contemporary-romance": 41, "romance": 420, "erotic-romance": 52, "contemporary": 42, "fiction": 134,
    "love": 28, "bdsm": 118, "chick-lit": 32, "adult": 69, "erotica": 180,
}


@pytest.mark.parametrize(
    "tags, gtype, mapped",
    [
        (ODYSSEY, "fiction", {"general-fiction": 613, "fantasy": 1557, "poetry": 2880}),
        (SHADES, "fiction", {"romance": 420}),
        ({"non-fiction": 5, "war": 3, "travel": 2}, "non-fiction", {"non-fiction": 5, "history": 3, "other": 2}),
        ({"war": 3}, "", {}),
        ({"fiction": 9, "non-fiction": 8, "roman": 1}, "fiction", {"non-fiction": 8, "historical-fiction": 1}),
        ({"history": 4, "fiction": 1}, "fiction", {"history": 4}),
        ({"non-fiction": 1, "history": 2, "war": 7}, "non-fiction", {"non-fiction": 1, "history": 7}),
    ],
)
def test_consolidate(spark, tags, gtype, mapped):
    df = spark.createDataFrame([("b", k, v) for k, v in tags.items()], "entity string, label string, weight bigint")
    got = labels.consolidate(df).collect()
    assert [(r["entity"], r["gtype"], r["mapped"]) for r in got] == [("b", gtype, mapped)]


def test_consolidate_takes_other_rules(spark):
    df = spark.createDataFrame([("b", "x", 1), ("b", "y", 2)], "entity string, label string, weight bigint")
    got = labels.consolidate(df, rules=[labels.Rule("x", "", "z"), labels.Rule("y", "", "z")]).first()
    assert got["mapped"] == {"z": 2}


def test_vocabulary_sizes():
    assert len(vocab.MAIN_TAGS) == 10 and len(vocab.FOLDED_TAGS) == 23
    assert len(vocab.HISTORY_TAGS) == 6 and len(vocab.OTHER_TAGS) == 12
    assert sum(n for _, _, n in vocab.SHELF_PAGES) == 601 and len(vocab.SHELVES) == 7


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-1, 0, 9, 10, 99, 100, 101)], "v bigint")
    got = [(r["bin"], r["n"]) for r in profile.histogram(df, "v", 10, 0, 100).orderBy("bin").collect()]
    assert got == [(1, 2), (2, 1), *[(i, 0) for i in range(3, 10)], (10, 2)]


def test_profile_of_nothing_is_null(spark):
    got = profile.profile(spark.createDataFrame([], "text string")).first()
    assert tuple(got) == (0, None, None)


def test_document_stats(spark):
    df = spark.createDataFrame([("One. Two two!  Three",), ("",)], "text string")
    got = rows(profile.document_stats(df).drop("text"))
    assert got[1] == (20, 3, pytest.approx((4 + 8 + 5) / 3)) and got[0][:2] == (0, 0) and got[0][2] is None


def test_first_per_group_drops_directories_led_by_system_files(spark):
    df = spark.createDataFrame(
        [("d1", "b.txt", 1), ("d1", "a.txt", 2), ("d2", ".DS_Store", 3), ("d2", "c.txt", 4), ("d3", "readme", 5)],
        "dir string, file_name string, x int",
    )
    assert rows(groups.first_per_group(df)) == [("d1", "a.txt", 2)]
    assert rows(groups.first_per_group(df, filter_first=True)) == [("d1", "a.txt", 2), ("d2", "c.txt", 4)]


def test_top_n_beyond_the_window_limit_salts(spark):
    data = [("hot", i) for i in range(3000)] + [("cold", 7)]
    df = spark.createDataFrame(data, "g string, v bigint").repartition(4)
    got = groups.top_n_per_group(df, ["g"], [F.desc("v")], 1500)
    assert "_salt" in got._jdf.queryExecution().toString()
    want = sorted([("hot", 2999 - i, i + 1) for i in range(1500)] + [("cold", 7, 1)])
    assert rows(got) == want


def test_top_and_bottom_break_ties_by_term(spark):
    df = spark.createDataFrame([("c", t, w) for t, w in (("b", 1.0), ("a", 1.0), ("z", 0.0), ("y", 2.0))], "l string, t string, w double")
    assert [r[1] for r in sorted(rows(groups.top_features(df, "l", "t", "w", 2)), key=lambda r: r[3])] == ["y", "a"]
    assert [r[1] for r in sorted(rows(groups.bottom_features(df, "l", "t", "w", 2)), key=lambda r: r[3])] == ["z", "a"]


def _resolve_in_order(books, held, tagged):
    """The sequential meaning: a book sees what earlier books claimed."""
    held, out = set(held), {}
    for name in sorted(books):
        out[name] = (None, "skipped")
        for isbn in books[name]:
            if isbn in held:
                out[name] = (isbn, "duplicate")
                break
            if isbn in tagged:
                held.add(isbn)
                out[name] = (isbn, "processed")
                break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_candidates_equal_the_sequential_walk(spark, seed):
    rng = random.Random(seed)
    isbns = [f"i{k}" for k in range(30)]
    # One candidate heads a third of all books.
    books = {
        f"f{k:03}": (["i0"] if rng.random() < 0.33 else []) + rng.sample(isbns, rng.randint(0, 6)) for k in range(120)
    }
    held, tagged = rng.sample(isbns, 5), rng.sample(isbns, 12)
    got = catalog.resolve_candidates(
        spark.createDataFrame(list(books.items()), "file_name string, ids array<string>"),
        spark.createDataFrame([(i,) for i in held], "isbn string"),
        spark.createDataFrame([(i,) for i in tagged], "isbn string"),
    )
    assert {r["file_name"]: (r["isbn"], r["status"]) for r in got.collect()} == _resolve_in_order(books, held, tagged)


def test_combine_and_dedupe(spark):
    schema = catalog.LISTING_SCHEMA
    source = spark.createDataFrame(
        [("t", "a", "SF", "Z:\\x\\t.txt", "d1", "i1"), ("u", "a", "SF", "u.txt", "d2", "i2"), ("v", "a", "Other", "v", "d", "i")],
        schema,
    )
    target = spark.createDataFrame([("t", "a", "Old", "/old/t.txt", "d0", "i0")], schema)
    plain = rows(catalog.combine(source, target, "SF", "/new/"))
    assert [(r[0], r[3]) for r in plain] == [("t", "/old/t.txt"), ("t", "/new/t.txt"), ("u", "/new/u.txt")]
    single = rows(catalog.combine(source, target, "SF", "/new/", dedupe=True))
    assert [(r[0], r[3]) for r in single] == [("t", "/old/t.txt"), ("u", "/new/u.txt")]


def test_upsert_and_existence(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert rows(catalog.upsert(old, new, ["k"])) == [("a", 1), ("b", 3), ("c", 4)]
    assert rows(catalog.without_existing(old, new, "k")) == [("a", 1)]
    assert rows(catalog.with_existing(old, new, "k")) == [("b", 2)]


def test_resume_and_reset(spark):
    df = spark.createDataFrame([("/a", 0), ("/b", 1), ("/c", 2), ("/b", 3)], "dir string, pos bigint")
    assert rows(catalog.resume_from(df, "/b")) == [("/b", 1), ("/b", 3), ("/c", 2)]
    assert rows(catalog.resume_from(df, "/none")) == []
    ledger = spark.createDataFrame([("x", "skipped"), ("y", "processed")], "f string, status string")
    assert rows(catalog.reset_status(ledger, "skipped")) == [("x", "pending"), ("y", "processed")]


BOOK_PAGE = """<html>
<a class="actionLinkLite bookPageGenreLink" href="/genres/before">
<a href="/work/shelves/1">shelves</a> <a title="9 on the start line">
<a title="8 people, before any name">
<a class="actionLinkLite bookPageGenreLink" href="/genres/poetry">Poetry</a>
<a title="12 people shelved">
<a class="actionLinkLite bookPageGenreLink" href="/genres/poetry">Poetry</a> &gt; <a title="77 x">
<a class="actionLinkLite bookPageGenreLink" href="/genres/epic">Epic</a>
<a class="actionLinkLite bookPageGenreLink" href="/genres/war">War</a>
<a title="3 people">
<a title="4 people">
<a class="actionLinkLite bookPageGenreLink" href="/genres/odd">Odd</a>
<a title="1,2 people">
<a class="actionLinkLite bookPageGenreLink" href="/genres/poetry">Poetry</a>
<a title="5 people"> <a class="actionLink right bookPageGenreLink__seeMoreLink" href="#">
<a class="actionLinkLite bookPageGenreLink" href="/genres/after">
"""


def test_tag_counts(spark):
    df = spark.createDataFrame([(1, BOOK_PAGE), (2, "<html>"), (3, BOOK_PAGE.replace("\n", "\r\n"))], "id int, html string")
    got = extract.tag_counts(df, ["id"]).select("id", "label", "n")
    want = {("epic", 0), ("war", 4), ("odd", None), ("poetry", 5)}
    assert {tuple(r)[1:] for r in got.filter("id = 1").collect()} == want
    assert {tuple(r)[1:] for r in got.filter("id = 3").collect()} == want
    assert got.filter("id = 2").count() == 0


LISTING = """7 books
<option value="top-level" >
<a class="mediumText actionLinkLite" href="/genres/sf">science fiction</a>
   12,345 books
<a class="mediumText actionLinkLite" href="/genres/x">none</a>
<a class="mediumText actionLinkLite" href="/genres/art">art</a>
9 books
<div class="moreLink">
<a class="mediumText actionLinkLite" href="/genres/after">after</a>
"""


def test_listing_counts_and_merge(spark):
    other = LISTING.replace("9 books", "10 books").replace("science fiction", "maths")
    whole = LISTING.replace('<option value="top-level" >\n', "")
    df = spark.createDataFrame([(1, LISTING), (2, other), (0, whole)], "page int, html string")
    counts = extract.listing_counts(df, ["page"])
    assert {tuple(r) for r in counts.filter("page = 0").select("label", "n").collect()} == {
        ("science fiction", 12345), ("none", 0), ("art", 9)
    }
    assert rows(labels.merge_tag_counts(counts)) == [("art", 10), ("maths", 12345), ("none", 0), ("science fiction", 12345)]


def test_category_entries(spark):
    page = (
        '<a href="/titles/no.html">no</a>\n<div class="grid_13 omega">\n'
        '<a href="/titles/tom1.html">Tom</a> <i>x</i><br />by<br /> Mark T \n<p>no entry</p>\n'
        '<a href="/titles/war.html">War</a><br />Wells <div class="grid_6">\n<a href="/titles/end.html">e</a>'
    )
    got = rows(extract.category_entries(spark.createDataFrame([(page,)], "html string"), [], "b"))
    assert got[0] == ("tom1", "Tom", "Mark T", "b/send/1:text:.txt:text/tom1/tom1.txt", "b/titles/tom1.html")
    assert [r[0] for r in got] == ["tom1", "war"]


def _docs():
    rng = random.Random(7)
    words = {"en": "the cat sat on mat hat".split(), "fr": "le chat est sur la natte".split(), "de": "die katze auf der matte".split()}
    out = []
    for i in range(60):
        lang = ("en", "en", "fr", "de")[i % 4]
        pool = words[lang] + ["common", "zz9"]
        out.append((i, lang, " ".join(rng.choices(pool, k=rng.randint(0, 12)))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_docs(), "doc_id bigint, label string, text string")


def _tokens(text):
    return [t for t in text.lower().split() if len(t) > 1]


def test_tfidf_equals_brute_force(docs):
    counts = terms.term_counts(docs, ["doc_id"])
    got = {(r["doc_id"], r["term"]): r["tfidf"] for r in terms.tfidf(counts, terms.inverse_document_frequency(counts, docs), "doc_id").collect()}
    bags = {i: Counter(_tokens(t)) for i, _, t in _docs()}
    df = Counter(t for bag in bags.values() for t in bag)
    want = {}
    for i, bag in bags.items():
        w = {t: n * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, t): x / norm for t, x in w.items()}
    assert got == pytest.approx(want, abs=1e-12)


def test_naive_bayes_equals_brute_force(docs):
    train, test = terms.split_by_hash(docs, "doc_id", 30)
    model = bayes.fit(terms.term_counts(train, ["label"]), train)
    scored = bayes.score(model, terms.term_counts(test, ["doc_id"]), test, "doc_id", ["label"])
    got = {(r["doc_id"], s["label"]): s["score"] for r in scored.collect() for s in r["scores"]}
    train_ids = {r[0] for r in train.select("doc_id").collect()}
    by_class, n_c = defaultdict(Counter), Counter()
    for i, lang, t in _docs():
        if i in train_ids:
            by_class[lang].update(_tokens(t))
            n_c[lang] += 1
    vocabulary = set().union(*by_class.values())
    want = {}
    for i, _, t in _docs():
        if i not in train_ids:
            for c in n_c:
                mass = sum(by_class[c].values()) + len(vocabulary)
                want[i, c] = math.log(n_c[c] / len(train_ids)) + sum(
                    math.log((by_class[c][w] + 1) / mass) for w in _tokens(t) if w in vocabulary
                )
    assert got == pytest.approx(want)
    best = {r["doc_id"]: r["prediction"] for r in bayes.predict(scored, ["doc_id"]).collect()}
    assert best == {i: min(n_c, key=lambda c: (-got[i, c], c)) for i in best}
    proba = bayes.probabilities(scored, "doc_id").collect()
    assert all(abs(sum(p["probability"] for p in r["proba"]) - 1) < 1e-12 for r in proba)


def test_evaluation_equals_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.choice("abc"), rng.choice("abd")) for _ in range(80)]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    matrix = {(r[0], r[1]): r[2] for r in evaluate.confusion_matrix(df).collect()}
    assert matrix == {(a, b): pairs.count((a, b)) for a in "abcd" for b in "abcd"}
    shares = {(r[0], r[1]): r[3] for r in evaluate.normalise_rows(evaluate.confusion_matrix(df)).collect()}
    assert shares["d", "a"] is None and sum(shares["a", b] for b in "abcd") == pytest.approx(1)
    report = {r["label"]: r for r in evaluate.classification_report(df).collect()}
    for c in "abcd":
        tp = pairs.count((c, c))
        support, predicted = sum(a == c for a, _ in pairs), sum(b == c for _, b in pairs)
        p, r = tp / predicted if predicted else 0, tp / support if support else 0
        f1 = 2 * p * r / (p + r) if p + r else 0
        assert tuple(report[c])[1:] == pytest.approx((p, r, f1, support))
    total = sum(report[c]["f1"] * report[c]["support"] for c in "abcd") / 80
    assert report["avg / total"]["f1"] == pytest.approx(total)
    assert evaluate.accuracy(df).first()[0] == pytest.approx(sum(a == b for a, b in pairs) / 80)


def test_argmax_prefers_the_smallest_label(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0)], "k int, label string, score double")
    assert rows(evaluate.argmax_label(df, "k")) == [(1, "a")]


def test_split_is_complementary(docs):
    train, test = terms.split_by_hash(docs, "doc_id")
    assert train.count() + test.count() == 60 and train.join(test, "doc_id", "left_semi").count() == 0
    assert test.filter(hash_bucket(F.col("doc_id")) >= 25).count() == 0


def test_vocabulary_cut_breaks_ties_by_term(spark):
    df = spark.createDataFrame([("b", 1, 5), ("a", 1, 5), ("c", 1, 9)], "term string, df bigint, n bigint")
    assert [r[0] for r in terms.vocabulary_cut(df, 2).collect()] == ["c", "a"]


def test_tag_map_keeps_the_greatest_of_double_labels(spark):
    df = spark.createDataFrame([("e", "x", 1), ("e", "x", 3), ("e", "y", 2)], "entity string, label string, weight bigint")
    assert labels.collect_tags(df, ["entity"]).first()["tags"] == {"x": 3, "y": 2}


def test_category_pages_skips_empty_categories(spark):
    df = spark.createDataFrame([("A", 2), ("B", 0)], "category string, pages int")
    assert rows(extract.category_pages(df, "b")) == [("A", 1, "b/categories/A/1/en"), ("A", 2, "b/categories/A/2/en")]


@pytest.mark.parametrize("size", [0, 1, 37, 60, 61, 119, 120, 500])
def test_vocabulary_cut_at_ties_without_a_single_task(spark, size):
    """Whole counts above the cut, the first terms of the count it lies in."""
    rows = [(f"t{i:03d}", i % 7, [90, 40, 1][(i > 2) + (i > 59)]) for i in range(120)]
    df = spark.createDataFrame(rows, "term string, df bigint, n bigint").repartition(5)
    got = terms.vocabulary_cut(df, size).collect()
    want = sorted(rows, key=lambda r: (-r[2], r[0]))[:size]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 25, 99, 100, 101])
def test_first_n_over_several_ranges(spark, n):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k"), F.lit("x").alias("v")).repartition(7)
    got = groups.first_n(df, [F.desc("k")], n, parts=6)
    assert sorted(r["k"] for r in got.collect()) == sorted(range(100), reverse=True)[:n][::-1]
    assert groups.first_n(df.limit(0), [F.desc("k")], 3).collect() == []


def test_texts_are_dealt_out_and_single_terms_left_unstored(spark, monkeypatch):
    """No task counts the n-grams of a large split; a vocabulary cut stores repeated terms only."""
    docs = spark.createDataFrame([(i, f"a{i} b c d e") for i in range(40)], "doc_id int, text string").coalesce(1)
    assert terms.dealt(docs).rdd.getNumPartitions() == 1
    monkeypatch.setattr(terms, "TASK_CHARS", 50)
    parts = terms.dealt(docs)
    assert parts.rdd.getNumPartitions() == 9 and sorted(parts.collect()) == sorted(docs.collect())
    totals = terms.document_frequency(terms.term_counts(docs, ["doc_id"]))
    stored = []
    monkeypatch.setattr(terms, "materialise", lambda df, name: stored.append(materialise(df, name)) or stored[-1])
    rows = spark.createDataFrame([("x", 3, 3), ("y", 2, 2), ("z", 1, 1), ("w", 1, 1)], "term string, df bigint, n bigint")
    assert sorted(r["term"] for r in terms.vocabulary_cut(rows, 2).collect()) == ["x", "y"]
    assert [t.count() for t in stored] == [2]
    assert sorted(r["term"] for r in terms.vocabulary_cut(rows, 3).collect()) == ["w", "x", "y"]
    assert terms.vocabulary_cut(totals, 99).count() == 40
    assert terms.vocabulary_cut(rows, 0).count() == 0
