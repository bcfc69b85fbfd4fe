"""Licence scans by a positional rare-token index.

Templates are mentions (a phrase) and texts of licences (a notice of 20 to 70 words around its
mandatory phrase).  A pass over all documents counts in how many each template word occurs.  The
words of a mandatory phrase with the highest inverse document frequency become its index entries,
and their postings are (template, position).  A file looks up its own words in that index; each hit
votes for a (template, start) by relative position, and the postings of a template are intersected:
a start stays if every entry voted for it.  There the mandatory phrase is verified word by word, and
the words of the template that stand at their relative positions are weighed by their inverse
document frequency.  A text counts from ``SHARE`` of its own weight on, so that it may be edited or
cut outside its phrase.  A phrase holds each of its own rare words, so no place is missed whatever
the frequencies are.  The score is W / (W + ``HALF``) for the largest weight W of a place.

Words: A-Z lowered, runs of ASCII digits, letters and non-ASCII characters.  Everything runs on
DataFrame expressions; the only shuffle is the word count, whose result has at most one row for
each template word.  A file without any phrase's longest word skips the positional part.

A null or empty text has no words, no places and score 0.  Rows are independent of each other, so
repeated rows, ties and further columns change nothing.
"""

from __future__ import annotations

from math import log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Base phrases, then the method's own (label, mandatory phrase).
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
OWN = [
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("bsd", "bsd license"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "cc0 1 0 universal"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl-2.0", "mozilla public license version 2 0"),
    ("unlicense", "released into the public domain"),
]
# Texts of licences (label, mandatory phrase, text).
TEXTS = [
    (
        "apache-2.0-notice",
        "except in compliance with the license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    (
        "gpl-2.0-notice",
        "free software foundation either version 2 of the license",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ),
    (
        "gpl-3.0-notice",
        "free software foundation either version 3 of the license",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mit-text",
        "free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    (
        "mpl-2.0-notice",
        "terms of the mozilla public license v 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ),
    (
        "unlicense-text",
        "unencumbered software released into the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    ),
]
RARE = 2  #: index entries of a template: the rarest words of its phrase
SHARE = 60  #: per cent of a template's weight that must stand at its relative positions
UNIT, HALF = 1000, 10_000  #: weights are whole thousandths of a natural logarithm; the weight of score 0.5
_OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template(NamedTuple):
    label: str
    base: bool
    words: list[str]
    phrase: list[str]
    offset: int  #: where in the words the mandatory phrase starts


def _templates() -> list[Template]:
    out = [Template(label, True, phrase.split(), phrase.split(), 0) for label, phrase in BASE]
    out += [Template(label, False, phrase.split(), phrase.split(), 0) for label, phrase in OWN]
    return out + [Template(label, False, text.split(), phrase.split(), f" {text} ".split(f" {phrase} ")[0].count(" ")) for label, phrase, text in TEXTS]


def _anchors() -> list[str]:
    """Words of which any text with a template's phrase has one."""
    return sorted({max(t.phrase, key=len) for t in _templates()})


def _may_match(text: Column) -> Column:
    """Whether a text has an anchor (as a substring, in either case)."""
    return text.rlike("(?i)(?:" + "|".join(_anchors()) + ")")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _OTHER), lambda w: w != "")


def word_counts(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many of them each template word occurs (missing: 0)."""
    vocabulary = sorted({w for t in _templates() for w in t.words})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.array_intersect(F.array(*[F.lit(v) for v in vocabulary]), _words(text)).alias("words"))
    counted = found.select(F.explode(F.array_append("words", "")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    n = {r.word: r.n for r in counted}  # at most one row for each template word, and one for all documents
    return n.pop("", 0), n


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    templates = _templates()
    total, counts = word_counts(docs, text_col)
    weight = {w: 1 + round(UNIT * log((total + 1) / (counts.get(w, 0) + 1))) for t in templates for w in t.words}
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(templates):
        for word in sorted(set(t.phrase), key=lambda w: (-weight[w], w))[:rare]:
            postings.setdefault(word, []).extend((number, t.offset + at) for at, w in enumerate(t.phrase) if w == word)
    needs = [sum(number == n for found in postings.values() for n, _ in found) for number in range(len(templates))]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    # counting needs no lower case: the separators have no letters
    pieces = F.split("t", _OTHER)
    count = F.size(pieces) - F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) - F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    rows = rows.select("doc_id", count.cast("long").alias("n_words"), F.when(_may_match(F.col("t")), _words(F.col("t"))).alias("words"))
    entries = F.array(*[F.lit(w) for w in sorted(postings)])
    lists = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in postings[w]]) for w in sorted(postings)])
    hits = F.filter(F.transform("words", lambda w, i: F.struct(F.array_position(entries, w).cast("int").alias("entry"), i.alias("i"))), lambda h: h.entry > 0)
    votes = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(lists, h.entry), lambda p: F.struct(p.t.alias("t"), (h.i - p.p).alias("at")))))
    rows = rows.withColumn("votes", F.array_sort(votes))
    of = lambda values, v: F.element_at(F.array(*values), v["t"] + 1)
    # a start has one vote of each entry at most, so that many equal ones in a row are all of them
    agreed = F.filter("votes", lambda v, i: F.get("votes", i + of([F.lit(n) for n in needs], v) - 1) == v)
    rows = rows.select("doc_id", "n_words", "words", agreed.alias("starts"))
    phrases = [F.array(*[F.lit(w) for w in t.phrase]) for t in templates]
    opens = lambda v: v["at"] + of([F.lit(t.offset) for t in templates], v)
    sound = lambda v: (opens(v) >= 0) & (F.slice("words", F.greatest(opens(v), F.lit(0)) + 1, F.size(of(phrases, v))) == of(phrases, v))
    rows = rows.select("doc_id", "n_words", "words", F.filter("starts", sound).alias("starts"))
    wholes = [F.array(*[F.struct(F.lit(w).alias("word"), F.lit(weight[w]).cast("long").alias("weight")) for w in t.words]) for t in templates]
    here = lambda v: F.transform(of(wholes, v), lambda e, j: F.when(F.get("words", v["at"] + j) == e["word"], e["weight"]).otherwise(F.lit(0).cast("long")))
    weighed = F.transform("starts", lambda v: F.struct(v["t"].alias("t"), opens(v).alias("at"), F.aggregate(here(v), F.lit(0).cast("long"), lambda a, x: a + x).alias("weight")))
    none = F.array().cast("array<struct<t:int,at:int,weight:bigint>>")
    rows = rows.select("doc_id", "n_words", F.coalesce(weighed, none).alias("places"))
    enough = lambda v: v["weight"] * 100 >= of([F.lit(SHARE * sum(weight[w] for w in t.words)).cast("long") for t in templates], v)
    rows = rows.select("doc_id", "n_words", F.filter("places", enough).alias("places"))
    labels = F.array(*[F.lit(t.label) for t in templates])
    base = F.filter("places", lambda v: v.t < len(BASE))
    named = lambda p: F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda v: F.element_at(labels, v.t + 1)))), ",")
    starts = F.transform(base, lambda v: v["at"].cast("long"))
    most = F.array_max(F.transform("places", lambda v: v["weight"])).cast("double")
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("places")).alias("labels"), F.coalesce(most / (most + HALF), F.lit(0.0)).alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same rows in DuckDB SQL: phrases at every word position, without an index."""
    templates = _templates()
    values = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {t.phrase!r}, {t.offset})" for n, t in enumerate(templates))
    words = ", ".join(f"({n}, {j}, '{w}')" for n, t in enumerate(templates) for j, w in enumerate(t.words))
    return f"""
    WITH tpl(t, label, base, phrase, opens) AS (VALUES {values}),
    word(t, j, word) AS (VALUES {words}),
    w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
    seen AS (SELECT x, count(*) AS n FROM (SELECT unnest(list_distinct(ws)) AS x FROM w) GROUP BY x),
    weighted AS (SELECT t, j, word, 1 + CAST(round({UNIT} * ln(((SELECT count(*) FROM w) + 1) / (coalesce(n, 0) + 1))) AS BIGINT) AS weight FROM word LEFT JOIN seen ON x = word),
    whole AS (SELECT t, {SHARE} * sum(weight) AS least FROM weighted GROUP BY t),
    p AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w WHERE list_has_any(ws, {_anchors()!r})),
    found AS (SELECT p.doc_id, p.ws, p.i, tpl.* FROM p JOIN tpl ON p.ws[p.i + 1] = tpl.phrase[1] AND list_slice(p.ws, p.i + 1, p.i + len(tpl.phrase)) = tpl.phrase),
    hit AS (SELECT doc_id, i, f.t, any_value(label) AS label, any_value(base) AS base, sum(CASE WHEN i - opens + j >= 0 AND ws[i - opens + j + 1] = word THEN weight ELSE 0 END) AS weight
      FROM found f JOIN weighted ON weighted.t = f.t GROUP BY doc_id, i, f.t),
    kept AS (SELECT hit.* FROM hit JOIN whole ON whole.t = hit.t WHERE 100 * weight >= least),
    g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, CAST(max(weight) AS DOUBLE) AS most FROM kept GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(most / (most + {HALF}), 0.0::DOUBLE) AS score
    FROM w LEFT JOIN g ON w.doc_id = g.doc_id"""
