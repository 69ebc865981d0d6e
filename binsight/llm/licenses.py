"""License scans with a positional rare-token index (operator 13).

Templates are the wordings by which licences are named or granted.  The index
holds, for each template, the places of its rarest words, by their inverse
document frequency over all documents.  A document is looked up by the rarest
indexed words it has; words that stand as far apart in it as in a template point
to one place where the template would begin.  A place that enough of them point
to is reported if the template's mandatory phrases stand there.  DataFrame
functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.llm.catalog import register
from binsight.llm.common import table

#: Fixed values of the contract: phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Customary wordings: (label, words, mandatory phrases among them).
TEMPLATES = [
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("apache-2.0", "apache license version 2 0", ["apache license version 2"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ["except in compliance with the license"]),
    ("artistic", "artistic license", ["artistic license"]),
    ("bsd", "bsd 2 clause license", ["bsd 2 clause"]),
    ("bsd", "bsd 3 clause license", ["bsd 3 clause"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("boost", "boost software license version 1 0", ["boost software license"]),
    ("cc-by-nc", "cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "cc by nd 4 0", ["cc by nd"]),
    ("cc-by-sa", "cc by sa 4 0", ["cc by sa"]),
    ("cc", "licensed under a creative commons attribution 4 0 international license", ["creative commons"]),
    ("cc0", "creative commons zero cc0 1 0 universal", ["cc0"]),
    ("epl", "eclipse public license version 2 0", ["eclipse public license"]),
    ("gpl-2.0", "gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "gnu general public license version 3", ["general public license version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation", ["free software", "redistribute it and or modify it"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["with or without fee is hereby granted"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("mit", "mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("mpl", "mozilla public license version 2 0", ["mozilla public license"]),
    ("public-domain", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
#: Of a template's words the rarest, up to RARE and to PART of them, are indexed; a document is looked up
#: by up to PROBES indexed words; SHARE of a template's indexed places, and two, have to agree.
RARE, PART, PROBES, SHARE = 5, 0.6, 64, 0.6
#: Added to a start, which is negative where a text begins within a template, before it is coded.
MARGIN = 1000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _constant(values: list) -> Column:
    """An array of words or numbers, in one call."""
    return F.expr("array(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")")


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, _SEPARATORS), lambda w: w != "")


def document_frequency(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rows of ``words`` (words: array) that hold each word of the vocabulary: as many numbers as that has words."""
    known = _constant(vocabulary)
    rows = words.select(F.explode(F.array_intersect(known, F.col("words"))).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in rows}


def index(frequency: dict[str, int], templates=TEMPLATES) -> list[tuple[str, int, int]]:
    """Postings (word, template, place of the word in it) of each template's rarest words, rarest word first."""
    out = []
    for t, (_, text, _) in enumerate(templates):
        words = text.split()
        distinct = sorted(set(words), key=lambda w: (frequency[w], w))
        chosen = distinct[:min(RARE, math.ceil(PART * len(distinct)))]
        out += [(w, t, i) for i, w in enumerate(words) if w in chosen]
    return sorted(out, key=lambda p: (frequency[p[0]], *p))


def _base(words: Column) -> list[Column]:
    """Places of the base phrases: number, first and last word, labels."""
    some = F.arrays_overlap(words, F.array(F.lit("cc"), F.lit("general"), F.lit("rights")))
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    phrases = "|".join(BASE)
    found = some & F.rlike(line, F.lit(f" (?:{phrases}) "))
    # what stands before a place has as many spaces as words, and one at its start
    before = F.split(line, f"(?<= )(?:{phrases})(?= )", 2)[0]
    until = F.regexp_extract(line, f"(?s)^(.*) (?:{phrases}) ", 1)

    def spaces(c):
        return F.length(c) - F.length(F.replace(c, F.lit(" ")))

    count = F.when(some, F.regexp_count(line, F.lit(f"(?<= )(?:{phrases})(?= )"))).otherwise(0).cast("long")
    labels = F.array_compact(F.array(*[F.when(some & line.contains(f" {p} "), F.lit(k)) for p, k in BASE.items()]))
    return [count.alias("n_base"), F.when(found, spaces(before) - 1).cast("long").alias("first_word"),
            F.when(found, spaces(until)).cast("long").alias("last_word"), labels.alias("base_labels")]


def _starts(postings: list[tuple[str, int, int]], templates) -> Column:
    """Where templates would begin, by the words looked up: a number ((start + MARGIN) * templates + template) each."""
    lists: dict[str, list[tuple[int, int]]] = {}
    for w, t, i in postings:
        lists.setdefault(w, []).append((t, i))
    by_word = F.expr("map(" + ", ".join(f"'{w}', array({', '.join(f'{(MARGIN - i) * len(templates) + t}L' for t, i in ps)})"
                                        for w, ps in lists.items()) + ")")
    at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.cast("long").alias("at"))),
                  lambda s: F.array_contains("looked_up", s["word"]))
    moved = F.transform(at, lambda s: F.transform(F.try_element_at(by_word, s["word"]), lambda c: c + s["at"] * len(templates)))
    return F.array_sort(F.flatten(moved))


def _places(postings: list[tuple[str, int, int]], templates) -> Column:
    """array<template, label, start, share>: what enough of a template's indexed words agree on.

    In the sorted starts equal numbers stand side by side; the first of each run of
    them looks ahead for the others, so the work is in proportion to the starts.
    """
    total = [sum(t == i for _, i, _ in postings) for t in range(len(templates))]

    def agreeing(s, i):
        n = F.lit(1)
        for k in range(1, max(total)):
            n = n + F.coalesce((F.get("starts", i + k) == s).cast("int"), F.lit(0))
        return F.when((i > 0) & (F.get("starts", i - 1) == s), 0).otherwise(n)

    runs = F.transform("starts", lambda s, i: F.struct(
        (s % len(templates)).cast("int").alias("template"),
        (F.floor(s / len(templates)) - MARGIN).cast("int").alias("start"), agreeing(s, i).alias("n")))
    need = _constant([max(2, math.ceil(SHARE * n)) for n in total])
    indexed = _constant(total)
    label = _constant([name for name, _, _ in templates])
    return F.transform(F.filter(runs, lambda r: r["n"] >= F.get(need, r["template"])), lambda r: F.struct(
        r["template"].alias("template"), F.get(label, r["template"]).alias("label"), r["start"].alias("start"),
        (r["n"] / F.get(indexed, r["template"])).alias("share")))


def _phrases(templates) -> list[list[tuple[int, int, str]]]:
    """(place in the template, words, text) of each template's mandatory phrases."""
    out = []
    for _, text, phrases in templates:
        own = []
        for p in phrases:
            before, found, _ = f" {text} ".partition(f" {p} ")
            if not found:
                raise ValueError(f"{p!r} does not stand in {text!r}")
            own.append((len(before.split()), len(p.split()), p))
        out.append(own)
    return out


def _verified(templates) -> Column:
    """The places at which all mandatory phrases of the template stand."""
    lists = ", ".join("array(" + ", ".join(f"named_struct('place', {i}, 'n', {n}, 'text', '{p}')" for i, n, p in own) + ")"
                      for own in _phrases(templates))
    phrases = F.expr(f"array({lists})")

    def stands(place, phrase):
        first = place["start"] + phrase["place"] + 1
        return (first > 0) & (F.array_join(F.slice("words", F.greatest(first, F.lit(1)), phrase["n"]), " ") == phrase["text"])

    return F.filter("places", lambda p: F.forall(F.get(phrases, p["template"]), lambda ph: stands(p, ph)))


def licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """docs (doc_id, text, any more) -> a row per row: doc_id, n_words, n_base,
    first_word, last_word, base_labels, places (array of template, label, start
    word, share of its indexed places found; verified ones), labels, score.

    ``score``: 1 with a base place, else the largest share of a verified place,
    else half the largest of a place whose phrases are missing, else 0.  Null and
    empty texts have no words.  Repeated rows count as often as they stand.  An
    empty table has no rows.  ``templates``: (label, lower-case words, mandatory phrases among them).
    """
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    postings = index(document_frequency(words, vocabulary), templates)
    by_idf = _constant(list(dict.fromkeys(w for w, _, _ in postings)))
    looked = words.select("doc_id", "words", F.slice(F.array_intersect(by_idf, F.col("words")), 1, PROBES).alias("looked_up"))
    none = F.array().cast("array<struct<template:int,label:string,start:int,share:double>>")
    started = looked.select("doc_id", "words", F.when(F.size("looked_up") > 1, _starts(postings, templates)).alias("starts"))
    placed = started.select("doc_id", "words", F.when(F.size("starts") > 1, _places(postings, templates)).otherwise(none).alias("places"))
    checked = placed.select("doc_id", "words", "places", F.when(F.size("places") > 0, _verified(templates)).otherwise(none).alias("verified"))
    named = checked.select("doc_id", F.size("words").cast("long").alias("n_words"), *_base(F.col("words")), "places", "verified")

    def best(places):
        return F.array_max(F.transform(places, lambda p: p["share"]))

    return named.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_sort("base_labels").alias("base_labels"),
        F.col("verified").alias("places"),
        F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("verified", lambda p: p["label"])))).alias("labels"),
        F.coalesce(F.when(F.col("n_base") > 0, 1.0), best("verified"), best("places") / 2, F.lit(0.0)).alias("score"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


SQL = f"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '{_SEPARATORS}'), lambda w: w <> '') AS words FROM documents),
tokens AS MATERIALIZED (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS pos FROM docs),
base(phrase, label) AS (VALUES {_values(list(BASE.items()))}),
triples AS (SELECT rid, pos, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM tokens
            WINDOW o AS (PARTITION BY rid ORDER BY pos)),
standing AS (SELECT rid, pos, label FROM triples JOIN base
             ON phrase = word || ' ' || second OR phrase = word || ' ' || second || ' ' || third),
based AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS own
          FROM standing GROUP BY rid),
templates(t, label, body) AS (VALUES {_values([(t, label, text) for t, (label, text, _) in enumerate(TEMPLATES)])}),
phrases(t, place, n, body) AS (VALUES {_values([(t, *p) for t, own in enumerate(_phrases(TEMPLATES)) for p in own])}),
spots AS (SELECT t, unnest(string_split(body, ' ')) AS word, unnest(range(len(string_split(body, ' ')))) AS place FROM templates),
frequency AS (SELECT word, count(DISTINCT rid) AS df FROM tokens WHERE word IN (SELECT word FROM spots) GROUP BY word),
ranked AS (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), word) AS rank, count(*) OVER (PARTITION BY t) AS n
           FROM (SELECT DISTINCT t, word FROM spots) LEFT JOIN frequency USING (word)),
postings AS (SELECT t, word, place FROM spots JOIN ranked USING (t, word) WHERE rank <= least({RARE}, ceil({PART} * n))),
totals AS (SELECT t, count(*) AS indexed, greatest(2, ceil({SHARE} * count(*))) AS need FROM postings GROUP BY t),
known AS (SELECT rid, word, row_number() OVER (PARTITION BY rid ORDER BY df, word) AS rank
          FROM (SELECT DISTINCT rid, word FROM tokens WHERE word IN (SELECT word FROM postings)) JOIN frequency USING (word)),
agreed AS (SELECT k.rid, p.t, tk.pos - p.place AS start, count(*) AS n FROM known k JOIN tokens tk ON tk.rid = k.rid AND tk.word = k.word
           JOIN postings p ON p.word = k.word WHERE k.rank <= {PROBES} GROUP BY ALL),
places AS (SELECT rid, t, start, n / indexed AS share FROM agreed JOIN totals USING (t) WHERE n >= need),
checked AS (SELECT p.rid, p.t, p.start, any_value(share) AS share, bool_and(p.start + f.place >= 0
              AND array_to_string(d.words[p.start + f.place + 1:p.start + f.place + f.n], ' ') = f.body) AS stands
            FROM places p JOIN docs d USING (rid) JOIN phrases f ON f.t = p.t GROUP BY p.rid, p.t, p.start),
found AS (SELECT rid, list(label) FILTER (stands) AS labels, max(share) FILTER (stands) AS best, max(share) AS near
          FROM checked JOIN templates USING (t) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(labels, [])))), ','), '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, near / 2, 0.0) END AS DOUBLE) AS score
FROM docs LEFT JOIN based USING (rid) LEFT JOIN found USING (rid)
"""


@register("op13_licenses", SQL)
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")
