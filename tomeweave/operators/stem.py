"""Suffix stripping after the algorithm published in 1980, as SQL expressions.

A word is a run of consonant and vowel groups; ``y`` is a vowel after a consonant. The rules'
conditions on the number of vowel-consonant pairs in the stem become regular expressions, so
the whole stemmer runs in the JVM, once per distinct word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.functions.text import alphabetic_only, let, word_tokens
from tomeweave.sources.workspace import broadcast_if_few, materialise

CONSONANTS = "[^aeiou][^aeiouy]*"
VOWELS = "[aeiouy][aeiou]*"
ANY_PAIR = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"
ONE_PAIR = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}(?:{VOWELS})?$"
TWO_PAIRS = f"{ANY_PAIR}{VOWELS}{CONSONANTS}"
HAS_VOWEL = f"^(?:{CONSONANTS})?[aeiouy]"
SHORT = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"

# Suffix -> replacement, applied where the stem has a vowel-consonant pair.
LONG_SUFFIXES = {
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
MIDDLE_SUFFIXES = {
    "icate": "ic",
    "ative": "",
    "alize": "al",
    "iciti": "ic",
    "ical": "ic",
    "ful": "",
    "ness": "",
}
# Suffixes dropped where the stem has two pairs ("ion" only after s or t).
LAST_SUFFIXES = (
    "al",
    "ance",
    "ence",
    "er",
    "ic",
    "able",
    "ible",
    "ant",
    "ement",
    "ment",
    "ent",
    "ion",
    "ou",
    "ism",
    "ate",
    "iti",
    "ous",
    "ive",
    "ize",
)


def _stem_and_suffix(word: Column, suffixes) -> tuple[Column, Column]:
    # The lazy stem makes the suffix the longest that fits.
    pattern = f"^(.*?)({'|'.join(suffixes)})$"
    return F.regexp_extract(word, pattern, 1), F.regexp_extract(word, pattern, 2)


def _replace_suffix(word: Column, table: dict[str, str]) -> Column:
    def apply(w: Column) -> Column:
        stem, suffix = _stem_and_suffix(w, table)
        new = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), suffix)
        return F.when((suffix != "") & stem.rlike(ANY_PAIR), F.concat(stem, new)).otherwise(w)

    return let(word, apply)


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _plurals(word: Column) -> Column:
    return let(
        word,
        lambda w: F.when(w.rlike("(?:sses|ies)$"), _cut(w, 2))
        .when(w.rlike("[^s]s$"), _cut(w, 1))
        .otherwise(w),
    )


def _mend(word: Column) -> Column:
    """After a dropped -ed or -ing."""
    return let(
        word,
        lambda w: F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e")))
        .when(
            (F.right(w, F.lit(1)) == F.substring(w, -2, 1)) & w.rlike("[^aeiouylsz]$"), _cut(w, 1)
        )
        .when(w.rlike(SHORT), F.concat(w, F.lit("e")))
        .otherwise(w),
    )


def _past_forms(word: Column) -> Column:
    def apply(w: Column) -> Column:
        stem, suffix = _stem_and_suffix(w, ("eed", "ed", "ing"))
        return (
            F.when(suffix == "", w)
            .when(suffix == "eed", F.when(stem.rlike(ANY_PAIR), _cut(w, 1)).otherwise(w))
            .when(stem.rlike(HAS_VOWEL), _mend(stem))
            .otherwise(w)
        )

    return let(word, apply)


def _final_y(word: Column) -> Column:
    return let(
        word,
        lambda w: F.when(
            F.endswith(w, F.lit("y")) & _cut(w, 1).rlike(HAS_VOWEL),
            F.concat(_cut(w, 1), F.lit("i")),
        ).otherwise(w),
    )


def _last_suffix(word: Column) -> Column:
    def apply(w: Column) -> Column:
        stem, suffix = _stem_and_suffix(w, LAST_SUFFIXES)
        fits = (suffix != "") & stem.rlike(TWO_PAIRS) & ((suffix != "ion") | stem.rlike("[st]$"))
        return F.when(fits, stem).otherwise(w)

    return let(word, apply)


def _final_e(word: Column) -> Column:
    def apply(w: Column) -> Column:
        stem = _cut(w, 1)
        drop = stem.rlike(TWO_PAIRS) | (stem.rlike(ONE_PAIR) & ~stem.rlike(SHORT))
        return F.when(F.endswith(w, F.lit("e")) & drop, stem).otherwise(w)

    return let(word, apply)


def _final_double_l(word: Column) -> Column:
    return let(
        word,
        lambda w: F.when(F.endswith(w, F.lit("ll")) & w.rlike(TWO_PAIRS), _cut(w, 1)).otherwise(w),
    )


def stem(word: Column) -> Column:
    """Stem of a lower-case word; words of one or two letters stay."""
    inflected = _final_y(_past_forms(_plurals(word)))
    derived = _replace_suffix(_replace_suffix(inflected, LONG_SUFFIXES), MIDDLE_SUFFIXES)
    return F.when(F.length(word) <= 2, word).otherwise(
        _final_double_l(_final_e(_last_suffix(derived)))
    )


def stemmed_tokens(text: Column) -> Column:
    """A tokenizer: the stems of a text's alphabetic tokens, in order."""
    return F.transform(alphabetic_only(word_tokens(text)), stem)


def stem_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """Add ``stem`` to a table of distinct terms."""
    return vocabulary.withColumn("stem", stem(F.col("term")))


def stemmed_counts(counts: DataFrame, key: str) -> DataFrame:
    """``key, stem, tf`` from ``key, term, tf``: each distinct term is stemmed once.

    The stems are stored, so that the join may split the partitions of frequent terms.
    """
    stems = materialise(stem_vocabulary(counts.select("term").distinct()), "stems")
    return (
        counts.join(broadcast_if_few(stems), "term")
        .groupBy(key, "stem")
        .agg(F.sum("tf").cast("bigint").alias("tf"))
    )
