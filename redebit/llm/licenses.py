"""License scan: exact set-similarity join of text blocks with license templates, in native operations.

A block of a template is a window of twice its words that starts at one of its words (the text's
end may cut it). A block and a template join when at least ``THRESHOLD`` of the template's distinct
words are in the block. Every stretch of that many words that holds enough of a template lies in the
block at the stretch's first template word, so none is lost, wherever a statement stands or however
far it is stretched.

* The template words are ordered by their document frequency over the whole table, rarest
  first; a block must hold one of the first ``|T| - need + 1`` of them (prefix filter).
* A block must hold ``need`` places with template words: fewer places behind its start end the
  search (length filter), and the ``need``-th place from its start on must still lie in the window
  (positional filter).
* What passes is counted exactly.

The templates are a fixed list, so they travel as literals and no row is shuffled but one
count per template word. Documents without any prefix word never form blocks.

Edge cases: a null text counts as empty: no words, null positions, empty labels, score 0.
Repeated rows are scanned one by one; empty tables give an empty result.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases of the base labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Statements of well-known licenses, in words, with their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at",
     "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("all rights reserved", "all-rights-reserved"),
)
THRESHOLD = 0.9
#: Whatever is not a word: ASCII but digits and small letters, once capitals are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    text: str
    label: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def tokens(self) -> list[str]:
        return sorted(set(self.words))

    @property
    def need(self) -> int:
        return math.ceil(THRESHOLD * len(self.tokens) - 1e-9)


ALL = tuple(Template(*t) for t in TEMPLATES)


def spaced(text: Column) -> Column:
    """The words of a text with one space before, between and behind them.

    Lower-casing all letters gives the same words as lower-casing A-Z, but for the Kelvin sign,
    the one other character that becomes an ASCII letter; it is put out of the way first.
    """
    small = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(small, GAP, " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(line: Column, n_words: Column, phrase: str) -> Column:
    """Struct of how often the phrase stands in the spaced words, and its first and last place."""
    parts = F.split(line, f" {phrase}(?= )")
    behind = spaces(F.element_at(parts, -1)) - 1
    long = lambda c: c.cast("long")
    found = F.struct(
        long(F.size(parts) - 1).alias("n"),
        long(spaces(F.element_at(parts, 1))).alias("first"),
        long(n_words - behind - len(phrase.split())).alias("last"),
    )
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(F.contains(line, F.lit(f" {phrase} ")), found).otherwise(none)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once per row, however often lambdas in ``use`` refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(line: Column) -> Column:
    return F.split(F.trim(line), " ")


def global_order(docs: DataFrame) -> list[str]:
    """All template words, rarest first by the documents of the whole table that hold them."""
    tokens = sorted({w for t in ALL for w in t.tokens})
    held = F.array_intersect(F.array(*map(F.lit, tokens)), words_of(spaced(F.col("text"))))
    counts = {r.w: r.n for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(tokens, key=lambda w: (counts.get(w, 0), w))


def prefix(template: Template, order: list[str]) -> list[str]:
    ordered = sorted(template.tokens, key=order.index)
    return ordered[: len(ordered) - template.need + 1]


def matching_blocks(line: Column, words: Column, template: Template, order: list[str]) -> Column:
    """Array of structs: the blocks that join with ``template``."""
    wide, need = 2 * len(template.words), template.need
    literal = lambda values: F.array(*map(F.lit, values))
    ordered = sorted(template.tokens, key=order.index)
    tokens, first = literal(ordered), prefix(template, order)
    window = lambda start: F.slice(words, start, wide)

    def near(places: Column) -> Column:
        """The block starts (from 1) that pass the three filters."""
        last = F.size(places) - (need - 1)
        starts = F.filter(
            F.slice(places, 1, F.greatest(last, F.lit(0))),
            lambda start, i: F.element_at(places, i + need) < start + wide,
        )
        return F.filter(starts, lambda start: F.arrays_overlap(window(start), literal(first)))

    def block(start: Column) -> Column:
        held = F.size(F.array_intersect(tokens, window(start)))
        return F.struct(
            (start - 1).cast("long").alias("start"), F.lit(wide).cast("long").alias("words"),
            F.lit(template.label).alias("label"), (held / F.lit(float(len(ordered)))).alias("containment"),
        )

    places = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).isin(ordered))
    enough = (need - 0.5) / len(ordered)
    found = bound(places, lambda at: F.filter(F.transform(near(at), block), lambda b: b.containment > enough))
    any_first = [F.contains(line, F.lit(f" {w} ")) for w in first]
    return F.when(reduce(or_, any_first), found).otherwise(F.array()).cast(BLOCKS)


BLOCKS = "array<struct<start:long,words:long,label:string,containment:double>>"


def with_blocks(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the spaced words ``line``, ``n_words`` and the array ``blocks`` of every joining block."""
    order = global_order(docs)
    rare = sorted({w for t in ALL for w in prefix(t, order)})
    base = docs.select(*keep, spaced(F.col("text")).alias("line"))
    base = base.withColumn(
        "n_words", F.when(F.trim("line") == "", 0).otherwise(spaces(F.col("line")) - 1).cast("long")
    )
    found = bound(
        words_of(F.col("line")), lambda words: F.concat(*(matching_blocks(F.col("line"), words, t, order) for t in ALL))
    )
    # One regular expression over the prefix words of all templates decides whether blocks are formed.
    any_rare = F.col("line").rlike(f" (?:{'|'.join(rare)}) ")
    return base.withColumn("blocks", F.when(any_rare, found).otherwise(F.array()).cast(BLOCKS))


def license_blocks(docs: DataFrame) -> DataFrame:
    """Every joining pair: doc_id, start (in words), words, label, containment."""
    return with_blocks(docs, ["doc_id"]).select("doc_id", F.inline("blocks"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks."""
    found = with_blocks(docs, ["doc_id"])
    n_words, line = F.col("n_words"), F.col("line")
    for i, (phrase, _) in enumerate(PHRASES):
        found = found.withColumn(f"p{i}", phrase_places(line, n_words, phrase))
    places = [F.col(f"p{i}") for i in range(len(PHRASES))]
    base = F.array_compact(F.array(*(F.when(p.n > 0, F.lit(label)) for p, (_, label) in zip(places, PHRASES))))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    own = F.transform("blocks", lambda b: b.label)
    n_base = sum((p.n for p in places[1:]), places[0].n)
    best = F.array_max(F.transform("blocks", lambda b: b.containment))
    return found.select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.least(*(p.first for p in places)).alias("first_word"),
        F.greatest(*(p.last for p in places)).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )


def oracle() -> str:
    """The same result in DuckDB SQL, with every block of every template counted, one at each of its words."""
    listed = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    starts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        k = len(phrase.split())
        at = f"list_filter(range(0, n - {k - 1}), lambda i: array_to_string(w[i + 1:i + {k}], ' ') = '{phrase}')"
        starts.append(f"len({at})")
        firsts.append(f"list_min({at})")
        lasts.append(f"list_max({at})")
        labels.append(f"CASE WHEN len({at}) > 0 THEN ['{label}'] ELSE [] END")
    blocks = []
    for t in ALL:
        m = len(t.words)
        shared = f"len(list_intersect(w[i + 1:i + {2 * m}], {listed(t.tokens)}))"
        places = f"list_filter(range(0, n), lambda i: list_contains({listed(t.tokens)}, w[i + 1]))"
        blocks.append(
            f"list_transform(list_filter({places}, lambda i: {shared} >= {t.need}), "
            f"lambda i: {{'label': '{t.label}', 'c': {shared} / {float(len(t.tokens))}}})"
        )
    concat = lambda parts: " || ".join(f"({p})" for p in parts)
    words = (
        f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return f"""
WITH a AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT doc_id, w, len(w) AS n FROM a),
c AS (SELECT doc_id, n, {' + '.join(starts)} AS n_base, least({', '.join(firsts)}) AS first_word,
  greatest({', '.join(lasts)}) AS last_word, {concat(labels)} AS base, {concat(blocks)} AS blocks FROM b)
SELECT doc_id, n::BIGINT AS n_words, n_base::BIGINT AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(base || list_transform(blocks, lambda x: x.label))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(list_max(list_transform(blocks, lambda x: x.c)), 0)::DOUBLE END AS score,
  len(blocks)::BIGINT AS n_blocks
FROM c"""
