"""License scans: an exact set-similarity join of text blocks with templates.

A template is the word set of a license notice; a text's blocks are runs of two
neighbouring cells of words, a cell being as long as the longest template, so
that a notice always lies in some block as a whole.  A block meets a template if
it holds at least ``threshold`` of the template's distinct words.

Words are put into one global order, the rarest in the corpus first.  A block
that holds c of a template's n words has one of the template's n - c + 1 rarest
among all but the last c - 1 of its own (prefix filter), has c template words
at all (length filter), and the places of a shared word leave room for c shared
ones (positional filter).  Pairs that pass are verified by intersection.
DataFrame functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.running import safe_join

from .spark_util import documents

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the contract: words, phrases with their labels.
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Opening sentences and short notices of public licenses.
TEMPLATES = (
    ("agpl", "GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Share of a template's distinct words; distinct words of all templates at
#: most, and words of one: what is sent to the tasks is bounded by both.
THRESHOLD, MAX_VOCABULARY, MAX_TEMPLATE_WORDS = 0.9, 20_000, 1000


def words_of(text: Column) -> Column:
    """A text's words in order, A-Z in lower case; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD_RE), F.lit(0))


def python_words(text: str) -> list[str]:
    return re.findall(WORD_RE, text.translate(str.maketrans(UPPER, LOWER)))


class Templates:
    """Word sets of (label, text) templates: ``sets`` (label, words, c, text's
    length), ``cell`` words of a cell, ``vocabulary``."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        lists = [(label, python_words(text)) for label, text in templates]
        self.sets = [(label, sorted(set(w)), math.ceil(threshold * len(set(w)) - 1e-9)) for label, w in lists if w]
        self.cell = max((len(w) for _, w in lists), default=1)
        self.vocabulary = sorted({x for _, w in lists for x in w})
        if len(self.vocabulary) > MAX_VOCABULARY or self.cell > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates have {len(self.vocabulary)} distinct words and up to {self.cell} words; at most {MAX_VOCABULARY} and {MAX_TEMPLATE_WORDS} are taken")


def _literal(words: list[str]) -> Column:
    return F.lit(words) if words else F.array().cast("array<string>")


def word_order(docs: DataFrame, templates: Templates, text: str = "text") -> list[str]:
    """The templates' words, those of the fewest documents first.  The driver
    gets a count for each word of the templates, no more."""
    present = F.array_intersect(words_of(F.col(text)), _literal(templates.vocabulary))
    counts = docs.select(F.explode(present).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["word"]: r["n"] for r in counts}
    return sorted(templates.vocabulary, key=lambda w: (n.get(w, 0), w))


def license_blocks(docs: DataFrame, templates: Templates | None = None, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Every block of every text that meets a template: the columns of
    ``keys``, first_word, end_word (words from 0), label, template (its number),
    shared and containment.

    Null and empty texts have no blocks; equal rows give equal results, each
    its own.  Columns other than ``keys`` and ``text`` aren't read.
    """
    t = templates or Templates()
    order = word_order(docs, t, text)
    place = {w: i for i, w in enumerate(order)}
    rows, prefixes = [], set()
    for k, (label, words, c) in enumerate(t.sets):
        mine = sorted(words, key=place.__getitem__)
        for i, w in enumerate(mine[: len(mine) - c + 1]):
            prefixes.add(w)
            rows.append((w, k, label, i, len(mine), c, mine))
    least = min((c for _, _, c in t.sets), default=1)
    schema = "word string, template int, label string, _i int, _n int, _c int, _words array<string>"
    index = docs.sparkSession.createDataFrame(rows, schema)  # (threshold's rest + 1) rows for each template
    w = docs.select(*keys, words_of(F.col(text)).alias("_w")).filter(F.arrays_overlap("_w", _literal(sorted(prefixes))))
    cells = F.ceil(F.size("_w") / F.lit(t.cell)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(cells - 2, F.lit(0))), lambda b: b * t.cell)
    runs = F.transform(starts, lambda s: F.struct(s.alias("first_word"), F.slice("_w", s + 1, F.lit(2 * t.cell)).alias("w")))
    b = w.select(*keys, F.size("_w").alias("_size"), F.explode(runs).alias("_b"))
    # an intersection keeps its first side's order: the global one
    b = b.select(*keys, "_size", F.col("_b.first_word").alias("first_word"), F.array_intersect(_literal(order), F.col("_b.w")).alias("_s"))
    b = b.withColumn("_m", F.size("_s")).filter(F.col("_m") >= least)
    b = b.select("*", F.posexplode(F.slice("_s", F.lit(1), F.col("_m") - F.lit(least - 1))).alias("_j", "word"))
    pairs = b.join(F.broadcast(index), "word")
    room = F.least("_i", "_j") + F.least(F.col("_n") - F.col("_i"), F.col("_m") - F.col("_j"))
    pairs = pairs.filter((F.col("_m") >= F.col("_c")) & (F.col("_j") <= F.col("_m") - F.col("_c")) & (room >= F.col("_c")))
    pairs = pairs.withColumn("_both", F.array_intersect("_s", "_words"))
    # a pair is met at each of its shared words: it counts at the first
    met = pairs.filter((F.size("_both") >= F.col("_c")) & (F.get("_both", F.lit(0)) == F.col("word")))
    return met.select(
        *keys, F.col("first_word").cast("long").alias("first_word"), F.least(F.col("first_word") + 2 * t.cell, F.col("_size")).cast("long").alias("end_word"),
        "label", "template", F.size("_both").alias("shared"), (F.size("_both") / F.col("_n")).alias("containment"),
    )


def phrase_places(words: Column, phrase: list[str]) -> Column:
    """Places (from 0) where the words stand one after the other."""
    def here(i: Column) -> Column:
        test = F.lit(True)
        for k, x in enumerate(phrase):
            test = test & (F.get(words, i + k) == x)
        return test

    every = F.sequence(F.lit(0), F.size(words) - len(phrase))
    none = F.array().cast("array<int>")
    return F.when(F.arrays_overlap(words, F.lit(phrase[-1:])) & (F.size(words) >= len(phrase)), F.filter(every, here)).otherwise(none)


def scan(docs: DataFrame, templates: Templates | None = None, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_base,
    first_word, last_word, base_labels, labels, score.

    Labels of phrases and of the templates that a block meets; the score is 1
    with a phrase, else the largest containment of a met template, 0 without
    one.  Null texts are empty; rows of one doc_id and one text share their
    labels, and rows of one doc_id with different texts have their own.  Other
    columns aren't read, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", "text", F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(17), text).alias("_h2"))
    keys = ["doc_id", "_h1", "_h2"]
    blocks = license_blocks(keyed, templates, tuple(keys))
    found = blocks.groupBy(*keys).agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_most"))  # labels of the templates at most
    none = F.array().cast("array<string>")
    base = keyed.select(*keys, words_of(F.col("text")).alias("_w"))
    places = {f"_p{i}": phrase_places(F.col("_w"), p.split(" ")) for i, (p, _) in enumerate(phrases)}
    base = base.select(*keys, F.size("_w").cast("long").alias("n_words"), *(c.alias(n) for n, c in places.items()))
    every = F.concat(*(F.col(n) for n in places))
    own = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases))), lambda x: x.isNotNull())))
    base = base.select(*keys, "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), own.alias("_own"))
    out = safe_join(base, found, keys)
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_own", F.coalesce("_labels", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_most", F.lit(0.0))).alias("score"),
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    """All blocks against all templates."""
    t = Templates()
    q = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    sets = ", ".join(f"('{label}', {q(words)}, {c})" for label, words, c in t.sets)
    phrase = lambda p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split(" "), 1))
    tests = " ".join(f"WHEN {phrase(p)} THEN '{label}'" for p, label in PHRASES)
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_RE}') AS w FROM documents),
templates(label, words, c) AS (VALUES {sets}),
met AS (
  SELECT rid, list(DISTINCT label) AS labels, max(shared / len(words)) AS most
  FROM (SELECT rid, label, words, c, len(list_intersect(run, words)) AS shared
        FROM (SELECT rid, list_distinct(w[b * {t.cell} + 1:b * {t.cell} + {2 * t.cell}]) AS run
              FROM (SELECT *, unnest(range(0, greatest(ceil(len(w) / {t.cell})::BIGINT - 1, 1))) AS b FROM texts)), templates)
  WHERE shared >= c GROUP BY rid),
places AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
  FROM (SELECT rid, i, CASE {tests} END AS label FROM (SELECT rid, w, unnest(range(0, len(w))) AS i FROM texts)) WHERE label IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(p.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(p.labels, []) || coalesce(m.labels, []))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(most, 0.0) END::DOUBLE AS score
FROM texts LEFT JOIN met m USING (rid) LEFT JOIN places p USING (rid)
"""


OP11_SQL = _sql()
