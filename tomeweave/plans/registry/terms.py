"""Token, n-gram, vocabulary and tf-idf queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.functions.text import alphabetic_only
from tomeweave.operators import terms
from tomeweave.operators.stem import stem_vocabulary, stemmed_counts, stemmed_tokens
from tomeweave.plans.registry.tables import documents, sql_list, table
from tomeweave.sources.workspace import materialise

# A literal stop list over the languages of the corpus, the same on both sides.
STOP_WORDS = (
    *("the", "of", "and", "to", "in", "that", "is"),
    *("le", "la", "les", "de", "et", "en", "que"),
    *("der", "die", "und", "el", "los"),
)

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
TERM_COUNTS_SQL = f"""
counts as (
  select doc_id, lang, term, count(*) as tf
  from (select doc_id, lang, unnest({_TOKENS}) as term from documents)
  group by all)"""
BUCKET_SQL = "('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 100"


def counts(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return terms.term_counts(documents(spark, d, *keep, "text"), ["doc_id", *keep])


def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d)


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return terms.document_frequency(counts(spark, d))


def vocabulary_cut(spark: SparkSession, d: str) -> DataFrame:
    return terms.vocabulary_cut(document_frequency(spark, d), 5000)


def top_terms_per_label(spark: SparkSession, d: str) -> DataFrame:
    return terms.top_terms(counts(spark, d, "lang"), "lang", 25)


def top_terms_per_role(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return terms.top_terms(terms.term_counts(turns, ["role"]), "role", 25)


def tfidf(spark: SparkSession, d: str) -> DataFrame:
    c = counts(spark, d)
    idf = terms.inverse_document_frequency(c, documents(spark, d))
    weighted = terms.tfidf(c, idf, "doc_id")
    return weighted.withColumn("tfidf", F.round("tfidf", 6))


def tfidf_unseen(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary and idf of the training texts, applied to the test texts."""
    train, test = terms.split_by_hash(documents(spark, d, "text"), "doc_id")
    idf = terms.inverse_document_frequency(terms.term_counts(train, ["doc_id"]), train)
    weighted = terms.tfidf(terms.term_counts(test, ["doc_id"]), idf, "doc_id")
    return weighted.withColumn("tfidf", F.round("tfidf", 6))


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    train, test = terms.split_by_hash(documents(spark, d, "lang"), "doc_id")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "lang").agg(F.count("*").alias("n"))


def alphabetic_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return terms.alphabetic_vocabulary(documents(spark, d, "text"))


def alpha_stem_vocab(spark: SparkSession, d: str) -> DataFrame:
    return stem_vocabulary(alphabetic_vocabulary(spark, d))


def stemmed_term_counts(spark: SparkSession, d: str) -> DataFrame:
    alphabetic = terms.term_counts(
        documents(spark, d, "text"), ["doc_id"], tokenizer=lambda t: alphabetic_only(terms.word_tokens(t))
    )
    return stemmed_counts(alphabetic, "doc_id")


def stemmed_tokens_per_document(spark: SparkSession, d: str) -> DataFrame:
    """Stems in reading order, as the pluggable tokenizer gives them."""
    docs = documents(spark, d, "text")
    stems = docs.select("doc_id", F.array_join(stemmed_tokens(F.col("text")), " ").alias("stems"))
    return stems.select("doc_id", F.md5("stems").alias("stems_md5"))


def stop_word_filter(spark: SparkSession, d: str) -> DataFrame:
    tokens = terms.without_stop_words(terms.word_tokens(F.col("text")), STOP_WORDS)
    kept = documents(spark, d, "text").select("doc_id", tokens.alias("ts"))
    return kept.select("doc_id", F.size("ts").cast("bigint").alias("n_tokens"))


def stop_word_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Stop words taken from the data: every term of more than half of the documents."""
    c = counts(spark, d)
    n = documents(spark, d).agg(F.count("*").alias("n")).scalar()
    frequent = terms.document_frequency(c).filter(F.col("df") * 2 > n).select("term")
    return terms.drop_stop_words(c, materialise(frequent, "stop-words")).select("doc_id", "term", "tf")


def _ngram_totals(spark: SparkSession, d: str, tokenizer) -> DataFrame:
    grams = terms.term_counts(documents(spark, d, "text"), ["doc_id"], tokenizer=tokenizer)
    return terms.document_frequency(grams)


def _word_ngram_totals(spark: SparkSession, d: str, n: int) -> DataFrame:
    texts = terms.dealt(documents(spark, d, "text"))
    grams = terms.term_counts(texts, ["doc_id"], tokenizer=terms.ngram_tokenizer(n, stop_words=STOP_WORDS))
    return terms.document_frequency(grams)


def word_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return _word_ngram_totals(spark, d, 3)


def word_quadgram_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return terms.vocabulary_cut(_word_ngram_totals(spark, d, 4), 50000)


def char_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return _ngram_totals(spark, d, terms.ngram_tokenizer(2, "char"))


def char_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return _ngram_totals(spark, d, terms.ngram_tokenizer(3, "char"))


QUERIES = {
    "term_frequency": term_frequency,
    "document_frequency": document_frequency,
    "vocabulary_cut": vocabulary_cut,
    "top_terms_per_label": top_terms_per_label,
    "top_terms_per_role": top_terms_per_role,
    "tfidf": tfidf,
    "tfidf_unseen": tfidf_unseen,
    "split_counts": split_counts,
    "alphabetic_vocabulary": alphabetic_vocabulary,
    "alpha_stem_vocab": alpha_stem_vocab,
    "stemmed_term_counts": stemmed_term_counts,
    "stemmed_tokens": stemmed_tokens_per_document,
    "stop_word_filter": stop_word_filter,
    "stop_word_anti_join": stop_word_anti_join,
    "word_trigrams": word_trigrams,
    "word_quadgram_vocabulary": word_quadgram_vocabulary,
    "char_bigrams": char_bigrams,
    "char_trigrams": char_trigrams,
}

_FREQUENCY_SQL = "frequency as (select term, count(*) as df, sum(tf)::bigint as n from counts group by term)"


def _char_ngrams_sql(n: int) -> str:
    return rf"""
with flat as (select doc_id, regexp_replace(lower(text), '[\s\x0b][\s\x0b]+', ' ', 'g') as t from documents),
chars as (select doc_id, string_split(t, '') as cs from flat),
counts as (
  select doc_id, g, count(*) as tf
  from (select doc_id, unnest([{" || ".join(f"cs[i + {k}]" for k in range(n))}
          for i in generate_series(1, len(cs) - {n - 1})]) as g from chars)
  group by all)
select g as term, count(*) as df, sum(tf)::bigint as n from counts group by g"""


def _word_ngrams_sql(n: int) -> str:
    return f"""
with tokens as (
  select doc_id, [x for x in {_TOKENS} if x not in ({sql_list(STOP_WORDS)})] as ts from documents),
counts as (
  select doc_id, g, count(*) as tf
  from (select doc_id, unnest([{" || ' ' || ".join(f"ts[i + {k}]" for k in range(n))}
          for i in generate_series(1, len(ts) - {n - 1})]) as g from tokens)
  group by all)
select g as term, count(*) as df, sum(tf)::bigint as n from counts group by g"""


def _replaced_sql(table: dict[str, str], condition: str, ion: bool = False) -> str:
    """The first suffix that fits, longest first, replaced if its stem meets the condition."""
    cases = []
    for suffix in sorted(table, key=len, reverse=True):
        stem = f"left(w, length(w) - {len(suffix)})"
        test = f"regexp_matches({stem}, '{condition}')"
        if ion and suffix == "ion":
            test += f" and regexp_matches({stem}, '[st]$')"
        cases.append(
            f"when suffix(w, '{suffix}') then case when {test} then {stem} || '{table[suffix]}' else w end"
        )
    return "case " + " ".join(cases) + " else w end"


# Spelled out once more for the SQL side: conditions, and the rules' suffixes (fixed values).
_HAS_VOWEL = "^(?:[^aeiou][^aeiouy]*)?[aeiouy]"
_ANY_PAIR = "^(?:[^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou][^aeiouy]*"
_ONE_PAIR = "^(?:[^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou][^aeiouy]*(?:[aeiouy][aeiou]*)?$"
_TWO_PAIRS = "^(?:[^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou][^aeiouy]*[aeiouy][aeiou]*[^aeiou][^aeiouy]*"
_SHORT = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"
_LONG = {
    "ational": "ate",
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "izer": "ize",
    "abli": "able",
    "alli": "al",
    "entli": "ent",
    "eli": "e",
    "ousli": "ous",
    "ization": "ize",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "iveness": "ive",
    "fulness": "ful",
    "ousness": "ous",
    "aliti": "al",
    "iviti": "ive",
    "biliti": "ble",
}
_MIDDLE = {
    "icate": "ic",
    "ative": "",
    "alize": "al",
    "iciti": "ic",
    "ical": "ic",
    "ful": "",
    "ness": "",
}
_LAST = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_STEMS_SQL = rf"""
words as materialized (
  select term, count(*) as n from (select unnest({_TOKENS}) as term from documents)
  where regexp_full_match(term, '[\p{{L}}\s]+') group by term),
plurals as materialized (
  select term, case when suffix(term, 'sses') or suffix(term, 'ies') then left(term, length(term) - 2)
                    when regexp_matches(term, '[^s]s$') then left(term, length(term) - 1)
                    else term end as w
  from words),
cuts as materialized (
  select term, w,
         case when suffix(w, 'eed') then null
              when suffix(w, 'ed') and regexp_matches(left(w, length(w) - 2), '{_HAS_VOWEL}')
                then left(w, length(w) - 2)
              when suffix(w, 'ing') and regexp_matches(left(w, length(w) - 3), '{_HAS_VOWEL}')
                then left(w, length(w) - 3) end as cut
  from plurals),
past as materialized (
  select term,
         case when suffix(w, 'eed') and regexp_matches(left(w, length(w) - 3), '{_ANY_PAIR}')
                then left(w, length(w) - 1)
              when cut is null then w
              when regexp_matches(cut, '(at|bl|iz)$') then cut || 'e'
              when length(cut) > 1 and right(cut, 1) = left(right(cut, 2), 1)
                   and right(cut, 1) not in ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z')
                then left(cut, length(cut) - 1)
              when regexp_matches(cut, '{_SHORT}') then cut || 'e'
              else cut end as w
  from cuts),
final_y as materialized (
  select term, case when suffix(w, 'y') and regexp_matches(left(w, length(w) - 1), '{_HAS_VOWEL}')
                    then left(w, length(w) - 1) || 'i' else w end as w
  from past),
long_suffix as materialized (select term, {_replaced_sql(_LONG, _ANY_PAIR)} as w from final_y),
middle as materialized (select term, {_replaced_sql(_MIDDLE, _ANY_PAIR)} as w from long_suffix),
last_suffix as materialized (
  select term, {_replaced_sql(dict.fromkeys(_LAST, ""), _TWO_PAIRS, ion=True)} as w
  from middle),
final_e as materialized (
  select term,
         case when suffix(w, 'e') and (
                regexp_matches(left(w, length(w) - 1), '{_TWO_PAIRS}')
                or (regexp_matches(left(w, length(w) - 1), '{_ONE_PAIR}')
                    and not regexp_matches(left(w, length(w) - 1), '{_SHORT}')))
              then left(w, length(w) - 1) else w end as w
  from last_suffix),
stems as materialized (
  select term, n,
         case when length(term) <= 2 then term
              when suffix(w, 'll') and regexp_matches(w, '{_TWO_PAIRS}') then left(w, length(w) - 1)
              else w end as stem
  from final_e join words using (term))"""

ORACLES = {
    "alpha_stem_vocab": f"with {_STEMS_SQL} select term, n, stem from stems",
    "stemmed_term_counts": f"""
with {TERM_COUNTS_SQL}, {_STEMS_SQL}
select doc_id, stem, sum(tf)::bigint as tf from counts join stems using (term) group by all""",
    "stemmed_tokens": rf"""
with {_STEMS_SQL},
tokens as (
  select doc_id, unnest(ts) as term, generate_subscripts(ts, 1) as i from (
    select doc_id, [x for x in {_TOKENS} if regexp_full_match(x, '[\p{{L}}\s]+')] as ts from documents)),
joined as (
  select doc_id, string_agg(stem, ' ' order by i) as stems from tokens join stems using (term) group by doc_id)
select doc_id, md5(coalesce(stems, '')) as stems_md5 from documents left join joined using (doc_id)""",
    "term_frequency": f"with {TERM_COUNTS_SQL} select doc_id, term, tf from counts",
    "document_frequency": f"with {TERM_COUNTS_SQL}, {_FREQUENCY_SQL} select term, df, n from frequency",
    "vocabulary_cut": f"""
with {TERM_COUNTS_SQL}, {_FREQUENCY_SQL}
select term, df, n from frequency order by n desc, term limit 5000""",
    "top_terms_per_label": f"""
with {TERM_COUNTS_SQL},
totals as (select lang, term, sum(tf)::bigint as n from counts group by all)
select * from (
  select lang, term, n, row_number() over (partition by lang order by n desc, term) as rank from totals)
where rank <= 25""",
    "top_terms_per_role": f"""
with totals as (
  select role, term, count(*) as n from (select role, unnest({_TOKENS}) as term from conversations) group by all)
select * from (
  select role, term, n, row_number() over (partition by role order by n desc, term) as rank from totals)
where rank <= 25""",
    "tfidf": f"""
with {TERM_COUNTS_SQL},
idf as (
  select term, ln((1 + (select count(*) from documents)) / (1.0e0 + count(*))) + 1 as idf
  from counts group by term),
w as (select doc_id, term, tf, tf * idf as w from counts join idf using (term))
select doc_id, term, tf, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as tfidf from w""",
    "tfidf_unseen": f"""
with {TERM_COUNTS_SQL},
idf as (
  select term,
         ln((1 + (select count(*) from documents where {BUCKET_SQL} >= 25)) / (1.0e0 + count(*))) + 1 as idf
  from counts where {BUCKET_SQL} >= 25 group by term),
w as (
  select doc_id, term, tf, tf * idf as w from counts join idf using (term) where {BUCKET_SQL} < 25)
select doc_id, term, tf, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as tfidf from w""",
    "split_counts": f"""
select case when {BUCKET_SQL} < 25 then 'test' else 'train' end as part, lang, count(*) as n
from documents group by all""",
    "alphabetic_vocabulary": rf"""
select term, count(*) as n from (select unnest({_TOKENS}) as term from documents)
where regexp_full_match(term, '[\p{{L}}\s]+') group by term""",
    "stop_word_filter": f"""
select doc_id, len([x for x in {_TOKENS} if x not in ({sql_list(STOP_WORDS)})])::bigint as n_tokens
from documents""",
    "stop_word_anti_join": f"""
with {TERM_COUNTS_SQL}, {_FREQUENCY_SQL}
select doc_id, term, tf from counts
where term not in (select term from frequency where df * 2 > (select count(*) from documents))""",
    "word_trigrams": _word_ngrams_sql(3),
    "word_quadgram_vocabulary": _word_ngrams_sql(4) + " order by n desc, term limit 50000",
    "char_bigrams": _char_ngrams_sql(2),
    "char_trigrams": _char_ngrams_sql(3),
}
