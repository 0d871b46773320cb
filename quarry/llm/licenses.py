"""Operator 4: license scans by an exact set-similarity join (DataFrame functions only).

Base labels are places where a phrase's words stand consecutively.  The method finds notices that
are re-wrapped or slightly reworded: a text block is labelled if it contains at least the
template's threshold of the template's distinct words.

1. Blocks.  Templates fall into two classes by length (``SHORT`` words or the longest template's);
   with M the class's length, the blocks are 2M words, one every M words, so every passage of up to
   M words lies within some block.
2. Global order.  The template words are counted over all documents; a set's words are ordered
   from the rarest to the most frequent (ties by word).
3. Prefix filter.  A block with at least o of a template's t words shares one of the template's
   first t-o+1 words, within the block's own first b-o+1; only blocks with such a word leave their
   row.  Length filter: b >= o.  Positional filter: from places i and j of the shared word at most
   1 + min(t-i-1, b-j-1) words can be shared, which must reach o.  Candidates come from a join of
   the blocks' words with the templates' prefix index.
4. Candidates are verified by full intersection.

Words of a block that no template has cannot be shared, so a block's set is limited to template
words; that changes no intersection.

Edge cases: a NULL or empty text has no words and labels "".  Repeated rows get equal results.
An empty table gives no rows.  Columns other than id and text are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, written

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Words of a short template at most.
SHORT = 16

# Phrases of the base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The licenses' own notices (label, share of the words that a block must have, text).
NOTICES = [
    ("mit", 0.8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("bsd", 0.8, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache", 0.8, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", 0.8, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl", 0.8, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", 0.8, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", 1.0, "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", 1.0, "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", 1.0, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", 1.0, "licensed under the GNU General Public License, version"),
    ("apache", 1.0, "Licensed under the Apache License, Version 2.0"),
    ("mit", 1.0, "Released under the MIT License"),
    ("all-rights-reserved", 1.0, "All rights reserved"),
]


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]  # distinct, in order of appearance
    length: int  # of the notice, in words
    least: int  # words that a block must share


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    return F.filter(F.split(low, GAP + "+"), lambda w: w != "")


def templates(notices: list[tuple[str, float, str]]) -> list[Template]:
    out = []
    for label, share, text in notices:
        words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).lower().split()
        distinct = tuple(dict.fromkeys(words))
        out.append(Template(len(out), label, distinct, len(words), math.ceil(share * len(distinct) - 1e-9)))
    return out


def size_classes(all_: list[Template]) -> dict[int, list[Template]]:
    """Templates by the block step of their class."""
    out: dict[int, list[Template]] = {}
    longest = max((t.length for t in all_), default=0)
    for t in all_:
        out.setdefault(SHORT if t.length <= SHORT else longest, []).append(t)
    return out


def word_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary from the rarest to the most frequent word over all rows of ``words`` (array)."""
    counted = words.select(F.explode("words").alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in counted}  # at most the templates' words
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def phrase_places(words: Column, text: Column, phrases: dict[str, str]) -> Column:
    """array(struct(i, label)) of the places of all phrases."""
    found = F.array().cast("array<struct<i:int,label:string>>")
    for phrase, label in phrases.items():
        p = phrase.split()

        def place(w: Column, i: Column) -> Column:
            same = w == p[0]
            for k in range(1, len(p)):
                same = same & F.coalesce(F.get(words, i + k) == p[k], F.lit(False))
            return F.when(same, F.struct(i.alias("i"), F.lit(label).alias("label")))

        # most texts lack the phrase's words altogether, which the text itself tells faster
        may = text.rlike("(?i)" + (GAP + "+").join(p))
        found = F.concat(found, F.when(may, F.filter(F.transform(words, place), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<i:int,label:string>>")))
    return found


def candidate_blocks(words: Column, classes: dict[int, list[Template]], order: list[str]) -> Column:
    """array(struct(step, no, tokens)) of the blocks that hold a template's prefix word; tokens in global order."""
    out = F.array().cast("array<struct<step:int,no:int,tokens:array<string>>>")
    rank = {w: k for k, w in enumerate(order)}
    for step, some in classes.items():
        prefix = sorted({w for t in some for w in sorted(t.words, key=rank.get)[: len(t.words) - t.least + 1]})
        known = set().union(*(t.words for t in some))
        ordered = F.array(*[F.lit(w) for w in order if w in known])
        at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(prefix), F.floor(i / step).cast("int"))), lambda i: i.isNotNull())
        nos = F.filter(F.array_distinct(F.flatten(F.transform(at, lambda b: F.array(b - 1, b)))), lambda b: b >= 0)
        out = F.concat(out, F.transform(nos, lambda b: F.struct(
            F.lit(step).alias("step"), b.alias("no"),
            F.array_intersect(ordered, F.slice(words, b * step + 1, 2 * step)).alias("tokens"))))
    return out


def prefix_index(spark: SparkSession, classes: dict[int, list[Template]], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(token, step, template, i, t, least) of the prefix words, and (template, label, words): both of fixed size."""
    rank = {w: k for k, w in enumerate(order)}
    index, table = [], []
    for step, some in classes.items():
        for t in some:
            words = sorted(t.words, key=rank.get)
            index += [(w, step, t.number, i, len(words), t.least) for i, w in enumerate(words[: len(words) - t.least + 1])]
            table.append((t.number, t.label, words))
    return (
        spark.createDataFrame(index, "token string, step int, template int, i int, t int, least int"),
        spark.createDataFrame(table, "template int, label string, words array<string>"),
    )


def matches(blocks: DataFrame, index: DataFrame, table: DataFrame) -> DataFrame:
    """(rid, step, no, label, containment) of every block of ``blocks`` (rid, step, no, tokens) that meets a template's threshold."""
    b = blocks.withColumn("b", F.size("tokens"))
    tokens = b.select("*", F.posexplode("tokens").alias("j", "token"))
    pairs = tokens.join(F.broadcast(index), ["token", "step"]).where(
        (F.col("b") >= F.col("least")) & (F.col("j") <= F.col("b") - F.col("least"))
        & (1 + F.least(F.col("t") - F.col("i") - 1, F.col("b") - F.col("j") - 1) >= F.col("least")))
    pairs = pairs.groupBy("rid", "step", "no", "template").agg(F.first("tokens").alias("tokens"), F.first("least").alias("least"), F.first("t").alias("t"))
    shared = F.size(F.array_intersect("tokens", "words"))
    full = pairs.join(F.broadcast(table), "template").withColumn("shared", shared).where(F.col("shared") >= F.col("least"))
    return full.select("rid", "step", "no", "label", (F.col("shared") / F.col("t")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: list[tuple[str, float, str]] = NOTICES) -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    classes = size_classes(templates(notices))
    vocabulary = sorted({w for some in classes.values() for t in some for w in t.words})
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).withColumn("words", words_of(F.col("text")))
    order = word_order(texts, vocabulary)
    base = texts.select(
        "id", F.size("words").cast("long").alias("n_words"),
        phrase_places(F.col("words"), F.col("text"), phrases).alias("places"),
        candidate_blocks(F.col("words"), classes, order).alias("blocks"))
    base = written(base.withColumn("rid", F.monotonically_increasing_id()), "licenses")
    blocks = base.select("rid", F.explode("blocks").alias("x")).select("rid", "x.*")
    index, table = prefix_index(spark, classes, order)
    found = matches(blocks, index, table).groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    out = base.drop("blocks").join(found, "rid", "left")
    places = F.col("places")
    base_labels = F.array_distinct(places["label"])
    none = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places["i"]).cast("long").alias("first_word"), F.array_max(places["i"]).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def oracle_sql(phrases: dict[str, str] = PHRASES, notices: list[tuple[str, float, str]] = NOTICES) -> str:
    """The same result in DuckDB SQL over ``documents``, every block compared with every template."""
    quote = lambda w: "'" + w + "'"
    rows = ", ".join(
        f"({step}, {quote(t.label)}, {t.least}, [{', '.join(map(quote, t.words))}])"
        for step, some in size_classes(templates(notices)).items() for t in some)
    ph = ", ".join(f"([{', '.join(map(quote, p.split()))}], {quote(label)})" for p, label in phrases.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
ph(p, label) AS (VALUES {ph}),
pl AS (SELECT rid, i, label FROM d, ph, unnest(range(0, len(ws))) AS u(i) WHERE ws[i + 1] = p[1] AND list_slice(ws, i + 1, i + len(p)) = p),
b AS (SELECT rid, count(*) AS n, min(i) AS f, max(i) AS l, list_distinct(list(label)) AS labels FROM pl GROUP BY rid),
t(step, label, least, w) AS (VALUES {rows}),
bl AS (SELECT rid, step, list_distinct(list_slice(ws, no * step + 1, no * step + 2 * step)) AS s
       FROM d, (SELECT DISTINCT step FROM t), unnest(range(0, (len(ws) + step - 1) // step)) AS u(no)),
m AS (SELECT rid, label, len(list_intersect(s, w)) / len(w) AS c FROM bl JOIN t USING (step) WHERE len(list_intersect(s, w)) >= least),
f AS (SELECT rid, list_distinct(list(label)) AS labels, max(c) AS best FROM m GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base,
  CAST(b.f AS BIGINT) AS first_word, CAST(b.l AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(f.best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)
"""
