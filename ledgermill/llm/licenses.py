"""License scans: an exact set-similarity join of text blocks with notice templates, all built-in functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases looked for word by word, and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Openings of public license notices, and their labels (fixed values).
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "reserved",
}
PERCENT = 80

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLOCK_END = r"[\r\n]+|[.!?;]\s+"


@dataclass(frozen=True)
class Template:
    """A template's distinct words, rarest in the corpus first, and how many a block must hold."""

    label: str
    words: tuple[str, ...]
    need: int

    @property
    def prefix(self) -> tuple[str, ...]:
        """Any block with ``need`` of the words has one of these."""
        return self.words[: len(self.words) - self.need + 1]


def lowered(text: Column) -> Column:
    """Lower case in which just A-Z become ASCII letters: the Kelvin sign and the dotted
    capital I, whose lower case begins with one, are replaced by other letters first."""
    kept = F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.lower(kept)


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_frequencies(docs: DataFrame, words: list[str]) -> DataFrame:
    """In how many rows of ``docs`` (text) each of ``words`` stands: (word, n)."""
    found = docs.select(
        F.explode(F.array_intersect(words_in(lowered(F.col("text"))), _strings(words))).alias("word")
    )
    return found.groupBy("word").agg(F.count("*").alias("n"))


def order_templates(
    docs: DataFrame, templates: dict[str, str], percent: int = PERCENT
) -> list[Template]:
    """The templates with their words in the corpus's order. What is fetched is a count for
    each distinct word of the templates, whatever the corpus holds."""
    sets = {text: sorted(set(re.findall(_WORD, text))) for text in templates}
    vocabulary = sorted({w for words in sets.values() for w in words})
    counted = dict(map(tuple, word_frequencies(docs, vocabulary).collect())) if vocabulary else {}
    return [
        Template(
            label,
            tuple(sorted(sets[text], key=lambda w: (counted.get(w, 0), w))),
            -(-percent * len(sets[text]) // 100),
        )
        for text, label in templates.items()
        if sets[text]
    ]


def _containment(block_words: Column, template: Template) -> Column:
    """The share of the template's words in the block; 0 unless it is large enough.

    The filters go from cheap to dear: a prefix word is there; the block is long enough;
    the first shared word leaves enough of the template behind it. Only then the words
    shared are counted.
    """
    own = _strings(template.words)
    prefixed = F.arrays_overlap(block_words, _strings(template.prefix))
    long_enough = F.size(block_words) >= template.need
    shared = F.array_intersect(own, block_words)
    first = F.array_position(own, F.get(shared, F.lit(0)))
    in_place = len(template.words) - first + 1 >= template.need
    enough = F.size(shared) >= template.need
    return F.when(
        prefixed & long_enough & in_place & enough, F.size(shared) / len(template.words)
    ).otherwise(0.0)


def _meets(k: int) -> Callable[[Column], Column]:
    return lambda block: block[k] > 0


def _phrase_places(words: Column, phrase: str) -> Column:
    """Starts of the places where the words of ``phrase`` stand one after another."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        match = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            match &= F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return match

    has_all = F.array_contains(words, parts[-1]) & F.array_contains(words, parts[0])
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), here)
    return F.when(has_all, places).otherwise(F.array().cast("array<int>"))


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    percent: int = PERCENT,
) -> DataFrame:
    """Phrases and license notices in each row of ``docs`` (doc_id, text).

    A block, the text between line breaks or ends of sentences, meets a template if it
    holds ``percent`` of its distinct words. All blocks that do are found: the templates'
    words are put in the order of their frequency over all documents, and prefix, length
    and positional filters leave out what cannot meet. The templates are the fixed, small
    side and travel with the plan, so rows stay where they lie and no key can be hot.

    Phrases are looked for in the words of the whole text, over blocks. ``score`` is 1
    with a phrase, else the best containment. Null and empty texts have no words, no
    labels (empty strings) and score 0. Null ids and repeated rows are carried through;
    other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    ordered = order_templates(docs, templates, percent)
    low = lowered(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", low.alias("_low")).withColumn("_words", words_in(F.col("_low")))
    words = F.col("_words")
    places = [_phrase_places(words, p).alias(f"_p{k}") for k, p in enumerate(phrases)]

    prefixes = sorted({w for t in ordered for w in t.prefix})
    blocks = F.transform(
        F.filter(
            F.transform(F.split("_low", _BLOCK_END), lambda b: F.array_distinct(words_in(b))),
            lambda b: F.arrays_overlap(b, _strings(prefixes)),
        ),
        lambda b: F.array(*[_containment(b, t) for t in ordered]),
    )
    none = F.array().cast("array<array<double>>")
    scored = F.when(F.arrays_overlap(words, _strings(prefixes)), blocks).otherwise(none)
    rows = rows.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), *places,
        (scored if ordered else none).alias("_blocks"),
    )

    all_places = F.concat(*[F.col(f"_p{k}") for k in range(len(phrases))])
    base = F.concat(
        *[
            F.when(F.size(f"_p{k}") > 0, F.array(F.lit(label))).otherwise(
                F.array().cast("array<string>")
            )
            for k, label in enumerate(phrases.values())
        ]
    )
    met = F.filter(
        F.array(
            *[
                F.when(F.exists("_blocks", _meets(k)), F.lit(t.label))
                for k, t in enumerate(ordered)
            ],
            F.lit(None).cast("string"),
        ),
        lambda label: label.isNotNull(),
    )
    best = F.coalesce(F.array_max(F.flatten("_blocks")), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, met))), ",").alias("labels"),
        F.when(F.size(all_places) > 0, 1.0).otherwise(best).alias("score"),
    )
