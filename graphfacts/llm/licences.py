"""Licence scan over a positional index of rare words.

The index holds, for every mandatory key phrase, its words of highest inverse document frequency, counted over all
documents, with their places in the phrase. A text is looked up by those rare words only; the places they imply for
the phrase are intersected, so both must agree on one start, and the whole phrase is verified there. The rest of the
template around the phrase then says how much of the licence notice is present.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfacts.llm.shared import LOWER, UPPER, text_of


class Template(NamedTuple):
    label: str
    words: str
    key: str
    base: bool = False


# The notices looked for, each with the phrase that must stand in it word for word.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute this software"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)

#: Share of a template's words that must stand at their places for its label.
COVERAGE = 0.6
#: Rare words looked up for each key phrase.
RARE = 2

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def words_of(text: Column) -> Column:
    """The words of a text. Only A-Z are lowered as far as words of the index go: the one other character whose lower
    case is ASCII, the Kelvin sign, is masked first."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("K"), F.lit("�"))), F.lit(WORD), F.lit(1))


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of a fixed vocabulary occurs; as many rows reach the driver as it has words."""
    found = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary)))
    rows = text_of(docs).select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in rows}


def rarest(key: list[str], frequency: dict[str, int], rare: int = RARE) -> list[int]:
    """The places of a phrase's words of highest inverse document frequency, ties by place."""
    return sorted(range(len(key)), key=lambda i: (frequency.get(key[i], 0), i))[:rare]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row per input row.

    A template is present where its key phrase stands word for word and at least ``coverage`` of all its words stand at
    their places around it; base templates are their key phrase. ``n_base``, ``first_word`` and ``last_word`` count
    every place of every base phrase. ``score`` is the largest share of a template seen around one of its key phrases.
    Null and empty texts have no words, empty labels, null places and score 0. Other columns are ignored; an empty
    table gives an empty result. Nothing is shuffled but the word counts of the index.
    """
    keys = [t.key.split() for t in templates]
    frequency = document_frequency(docs, sorted({w for k in keys for w in k}))
    postings = [rarest(k, frequency) for k in keys]
    looked_up = sorted({k[q] for k, places in zip(keys, postings) for q in places})

    w = F.col("_words")
    rows = text_of(docs).select("doc_id", words_of(F.col("text")).alias("_words"))
    at = F.when(F.size(w) > 0, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(looked_up))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", "_words", at.alias("_at"))
    # one small list of places for each looked-up word, then everything else works on those
    def standing(word: str) -> Column:
        return F.filter("_at", lambda i: F.get(w, i) == word)

    rows = rows.select("doc_id", "_words", *[standing(word).alias(f"_at_{n}") for n, word in enumerate(looked_up)])

    def implied(word: str, place: int) -> Column:
        return F.transform(f"_at_{looked_up.index(word)}", lambda p: p - place)

    def starts(key: list[str], places: list[int]) -> Column:
        found = [implied(key[q], q) for q in places]
        both = found[0]
        for other in found[1:]:
            both = F.array_intersect(both, other)
        return F.filter(both, lambda s: (s >= 0) & (F.slice(w, F.greatest(s, F.lit(0)) + 1, len(key)) == F.array(*map(F.lit, key))))

    rows = rows.select("doc_id", "_words", *[starts(k, q).alias(f"_key_{n}") for n, (k, q) in enumerate(zip(keys, postings))])

    def shares(n: int) -> Column:
        words = templates[n].words.split()
        key_at = next(i for i in range(len(words)) if words[i:i + len(keys[n])] == keys[n])

        def share(p: Column) -> Column:
            there = [F.when(F.when(p + (i - key_at) >= 0, F.get(w, p + (i - key_at))) == word, 1).otherwise(0) for i, word in enumerate(words)]
            total = there[0]
            for x in there[1:]:
                total = total + x
            return total / len(words)

        return F.coalesce(F.array_max(F.transform(f"_key_{n}", share)), F.lit(0.0))

    base = [n for n, t in enumerate(templates) if t.base]
    rows = rows.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"),
        F.concat(*[F.col(f"_key_{n}") for n in base]).alias("_base"),
        *[shares(n).alias(f"_share_{n}") for n in range(len(templates))])

    def labels(among) -> Column:
        each = [F.when(F.col(f"_share_{n}") >= coverage, F.lit(templates[n].label)) for n in among]
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(F.array(*each)))))

    return rows.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base").cast("long").alias("first_word"), F.array_max("_base").cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(range(len(templates))).alias("labels"),
        F.greatest(*[F.col(f"_share_{n}") for n in range(len(templates))]).alias("score"))


def sql(templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE) -> str:
    """The same result without an index."""
    rows = []
    for n, t in enumerate(templates):
        words, key = t.words.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        rows.append(f"({n}, '{t.label}', {t.base}, {words}, {at}, {key})")
    return rf"""
WITH t(n, label, base, words, key_at, key) AS (VALUES {', '.join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
wp AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
places AS (SELECT r, n, label, base, words, key_at, w, p FROM wp JOIN t ON word = key[1] JOIN d USING (r)
           WHERE w[p + 1:p + len(key)] = key),
seen AS (SELECT r, label, base, p, len(list_filter(range(len(words)), lambda i:
           p + i - key_at >= 0 AND w[p + i - key_at + 1] IS NOT DISTINCT FROM words[i + 1])) / len(words) AS share FROM places),
per AS (SELECT r, count(*) FILTER (base) AS n_base, min(p) FILTER (base) AS first_word, max(p) FILTER (base) AS last_word,
          list_sort(list_distinct(list(label) FILTER (base))) AS bl, list_sort(list_distinct(list(label) FILTER (share >= {coverage}))) AS l,
          max(share) AS score FROM seen GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN per USING (r)
"""
