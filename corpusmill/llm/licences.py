"""Licence scans by an exact set-similarity join of text blocks with licence templates.

A text is read as lower-case words and cut into blocks of ``BLOCK`` words, one every ``BLOCK`` / 2, so
every passage of up to half a block lies whole in some block. A block holds a licence if it has at
least ``THRESHOLD`` of the different words of one of its templates.

Words are ordered by how often the corpus has them, rarest first. A template of m words needs
o = ceil(THRESHOLD m) of them in a block, so a block that holds it has one of the template's first
m - o + 1 words among its own first words (prefix filter), has o words at all (length filter), and the
words after a common one still suffice on both sides (positional filter). Only pairs that pass all
three are compared word by word, so none that meets the threshold is lost.

Templates are a parameter of the caller: what is collected, and what is broadcast, is one row for each
of their words. Only Spark's own functions are used.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table
from corpusmill.operators.skew import lookup_join
from corpusmill.session import stage

BLOCK = 64  # words of a block
THRESHOLD = 0.8
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, after A-Z became a-z
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Sentences by which licences are granted, at most half a block each.
TEMPLATES = [
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def template_words(text: str) -> list[str]:
    """The different words of a template, as a text's words are read, in code-point order."""
    lowered = text.translate(str.maketrans(UPPER, LOWER))
    return sorted({w for w in re.split(APART, lowered) if w})


def _spaced(text: Column) -> Column:
    """The words of a text, two spaces before, between and after them; two spaces for null or no word."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), APART, "  ")


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _marks(text: Column) -> list[Column]:
    """128 bits that stand for a text: what is found in it is found once, whoever has it."""
    known = F.coalesce(text, F.lit(""))
    return [F.xxhash64(known).alias("_a"), F.xxhash64(F.lit("again"), known).alias("_b")]


def _literal(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """Rows made from the templates, in the JVM."""
    names = [f.split()[0] for f in schema.split(",")]
    kinds = [f.split()[1] for f in schema.split(",")]
    made = [F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(r, names, kinds)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def _ordered(words: DataFrame, templates: list[tuple[str, list[str]]]) -> dict[str, int]:
    """Place of each template word in the order of the corpus: rarest first, ties by the word."""
    wanted = sorted({w for _, held in templates for w in held})
    counted = (
        words.select(F.explode_outer("_words").alias("word"))  # without outer, Spark reads the words twice
        .where(F.col("word").isin(wanted))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frequency = {r["word"]: r["n"] for r in counted.collect()}  # a row for each template word at most
    return {w: i for i, w in enumerate(sorted(wanted, key=lambda w: (frequency.get(w, 0), w)))}


def matching_blocks(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """(_a, _b, block, template, label, containment): every block of a text of ``docs`` that has
    ``threshold`` of a template's words, a row for each such template.

    ``_a, _b`` stand for the text, ``template`` is the place in ``templates``, and ``block`` counts from
    0 in steps of half a block of words. A template without words is found nowhere; one of more words
    than half a block can be cut by a block's end and should be given in parts.
    """
    spark = docs.sparkSession
    read = [(i, label, template_words(text)) for i, (label, text) in enumerate(templates)]
    read = [t for t in read if t[2]]
    none = "_a bigint, _b bigint, block bigint, template int, label string, containment double"
    if not read:
        return spark.createDataFrame([], none)
    words = docs.select(*_marks(F.col("text")), F.split(F.btrim(_spaced(F.col("text"))), "  ").alias("_words"))
    place = _ordered(words, [(label, held) for _, label, held in read])

    postings, whole, first = [], [], set()
    for number, label, held in read:
        ranks = sorted(place[w] for w in held)
        needed = math.ceil(threshold * len(ranks) - 1e-9)
        whole.append((number, label, ranks, len(ranks), needed))
        for i, rank in enumerate(ranks[: len(ranks) - needed + 1]):
            postings.append((rank, number, i, len(ranks), needed))
            first.add(rank)
    rare = [w for w, rank in place.items() if rank in first]
    ranked = _literal(spark, "word string,rank int", list(place.items()))
    postings = _literal(spark, "rank int,template int,i int,m int,needed int", postings)
    whole = _literal(spark, "template int,label string,ranks array<int>,m int,needed int", whole)

    # texts without any word of a prefix hold no template and go no further
    near = words.where(F.arrays_overlap("_words", F.array(*[F.lit(w) for w in rare])))
    placed = near.select("_a", "_b", F.posexplode_outer("_words").alias("pos", "word")).join(F.broadcast(ranked), "word")
    half = block // 2
    number = F.floor(F.col("pos") / F.lit(half))
    placed = placed.select(
        "_a", "_b", "rank", F.explode(F.array(number, F.when(number > 0, number - 1))).alias("block")
    ).where(F.col("block").isNotNull())
    blocks = placed.groupBy("_a", "_b", "block").agg(F.sort_array(F.collect_set("rank")).alias("held"))

    n = F.size("held")
    met = blocks.select("*", F.posexplode("held").alias("j", "rank")).join(F.broadcast(postings), "rank")
    reach = F.least("i", "j") + 1 + F.least(F.col("m") - F.col("i") - 1, n - F.col("j") - 1)
    met = met.where((n >= F.col("needed")) & (F.col("j") <= n - F.col("needed")) & (reach >= F.col("needed")))
    pairs = met.groupBy("_a", "_b", "block", "template").agg(F.first("held").alias("held"))
    shared = F.size(F.array_intersect("held", "ranks"))
    found = pairs.join(F.broadcast(whole), "template").where(shared >= F.col("needed"))
    return found.select("_a", "_b", "block", "template", "label", (shared / F.col("m")).alias("containment"))


def _places(phrase: str) -> dict[str, Column]:
    """How often the phrase's words stand consecutively in ``_spaced``, and its first and last start."""
    inside = "".join(f" {w} " for w in phrase.split())
    # no phrase overlaps itself, so what lies between its places is what splitting leaves: words with a
    # space on both sides, and one more space at the outer end
    parts = F.when(F.contains("_spaced", F.lit(inside)), F.split("_spaced", inside, -1))
    before, after = [((_spaces(F.element_at(parts, at)) - 1) / F.lit(2)).cast("bigint") for at in (1, -1)]
    last = F.col("n_words") - after - len(phrase.split())
    return {"n": F.coalesce(F.size(parts) - 1, F.lit(0)), "first": before, "last": last}


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of ``docs``.

    ``n_base`` counts the places of ``phrases``, ``first_word`` and ``last_word`` are their smallest and
    largest start (null without any); ``labels`` are those of phrases and of templates, sorted and
    joined by commas, empty without any. ``score`` is 1 with a phrase, else the largest containment of a
    template that meets the threshold, else 0.

    A null or empty text has no words and no labels. Rows stay as many as they are, repeated ones and
    those with a null id included; columns besides doc_id and text play no part.
    """
    found = matching_blocks(docs, templates, threshold, block).groupBy("_a", "_b").agg(
        F.collect_set("label").alias("_found"),
        F.max("containment").alias("_most"),
        F.count(F.lit(1)).alias("_heat"),
    )
    spaced = docs.select(F.col("doc_id").cast("long"), *_marks(F.col("text")), _spaced(F.col("text")).alias("_spaced"))
    spaced = spaced.withColumn("n_words", (_spaces(F.col("_spaced")) / F.lit(2) - 1).cast("bigint"))
    for i, phrase in enumerate(phrases):
        spaced = spaced.withColumn(f"_p{i}", F.struct(*[c.alias(k) for k, c in _places(phrase).items()]))
    each = [F.col(f"_p{i}") for i in range(len(phrases))]
    labels = F.array(*[F.when(p["n"] > 0, F.lit(label)) for p, label in zip(each, phrases.values())])
    based = spaced.select(
        "doc_id",
        "_a",
        "_b",
        "n_words",
        reduce(lambda a, b: a + b, [p["n"] for p in each]).cast("bigint").alias("n_base"),
        F.array_min(F.array(*[p["first"] for p in each])).alias("first_word"),
        F.array_max(F.array(*[p["last"] for p in each])).alias("last_word"),
        F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))).alias("_base"),
    )
    both = lookup_join(based, stage(found, "licences"), ["_a", "_b"], "_heat")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_union("_base", F.coalesce("_found", none)))
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_most", F.lit(0.0))).alias("score"),
    )


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_WHOLE = ",\n  ".join(
    f"({i}, '{label}', {_quoted(template_words(text))})" for i, (label, text) in enumerate(TEMPLATES)
)
_BASE = ",\n  ".join(f"('{label}', {_quoted(p.split())}, {len(p.split())})" for p, label in PHRASES.items())

SQL = f"""
with templates(template, label, held) as (values
  {_WHOLE}),
phrases(label, held, n) as (values
  {_BASE}),
texts as (
  select rowid_ as r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{APART}'), lambda w: w <> '') as words
  from (select row_number() over () as rowid_, doc_id, text from documents)),
long as (
  select r, unnest(words) as word, generate_subscripts(words, 1) - 1 as pos, words from texts),
blocks as (
  select r, block, list(distinct word) as held
  from (select r, word, unnest([pos // {BLOCK // 2}, pos // {BLOCK // 2} - 1]) as block from long)
  where block >= 0 group by r, block),
near as (
  select r, label, len(list_intersect(b.held, t.held)) / len(t.held)::double as containment
  from blocks b, templates t
  where len(list_intersect(b.held, t.held)) >= ceil({THRESHOLD} * len(t.held) - 1e-9)),
places as (
  select l.r, l.pos, p.label from long l join phrases p on l.word = p.held[1]
  where l.words[l.pos + 1 : l.pos + p.n] = p.held),
base as (
  select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as labels
  from places group by r),
method as (select r, list(distinct label) as labels, max(containment) as most from near group by r)
select t.doc_id, len(t.words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base,
       first_word::bigint as first_word, last_word::bigint as last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') as base_labels,
       array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(m.labels, []))), ',') as labels,
       case when n_base > 0 then 1.0 else coalesce(m.most, 0.0) end::double as score
from texts t left join base b on t.r = b.r left join method m on t.r = m.r"""
