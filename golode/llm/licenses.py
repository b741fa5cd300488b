"""License scan: an exact set-similarity join of text blocks and license templates, natively.

Base: places where the words of a known phrase stand in a row. The join: a block (a line of a
text, or, since notices are wrapped over lines, a window over the words of a text of several
lines; windows are twice as long as the longest template and overlap by half, and of one that passes
the filters, parts of twice the template's own length count, which overlap by half as well) meets a
template when it holds at least THRESHOLD of the template's distinct words. Every text is read once: that pass
finds the base places and the template words of the text. A text that lacks too many words of each
template has no block that meets one; the others go on with their blocks. Tokens are ordered by how
many texts of the whole table hold them, rarest first. A block can only meet a
template of n words if it shares ``overlap = ceil(THRESHOLD * n)`` words with it, so
 - prefix filter: it holds one of the template's first n - overlap + 1 words in that order;
 - length filter: it holds at least ``overlap`` template words at all;
 - positional filter: from the first shared prefix word on, both sides still have enough words.
What is left is verified by intersection. The templates, and so the words that are counted and
broadcast, are a parameter of fixed size.

Defined results: null text counts as empty and has 0 words, no place, no label and score 0; an
empty table gives no rows; rows that repeat an id share the labels found in any of them; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from golode.llm.common import staged, table, text_or_empty

#: Phrases and the labels they stand for.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public license notices and the labels they stand for.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.8

#: What stands between words: all ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """The words of a template, as ``spaced`` has them."""
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]


def spaced(text: Column) -> Column:
    """' w1 w2 ... wn ', or a blank or two if there are no words."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, LOWER), F.lit(" ")), BETWEEN, " ")


def _blanks(part: Column) -> Column:
    return (F.char_length(part) - F.char_length(F.translate(part, " ", ""))).cast("long")


def read_once(docs: DataFrame, id_col: str, text_col: str, rows: list[dict], phrases=PHRASES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base (labels), held (the distinct template words)
    and, where some template may be met, text: one row per document."""
    either = "|".join(p for p, _ in phrases)
    cut = F.when(F.col("norm").contains("license"), F.split("norm", f" (?=(?:{either}) )"))
    found = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("norm", spaced(F.col("text")))
    found = found.withColumns(
        {"n_words": F.greatest(_blanks(F.col("norm")) - 1, F.lit(0)), "parts": cut, "held": F.array_intersect(F.split("norm", " "), dictionary(rows))}
    )
    may = [F.size(F.array_intersect("held", F.array(*map(F.lit, r["words"])))) >= r["overlap"] for r in rows]
    least = min(r["overlap"] for r in rows)
    return found.select(
        "id",
        "n_words",
        F.coalesce(F.size("parts") - 1, F.lit(0)).cast("long").alias("n_base"),
        F.when(F.size("parts") > 1, _blanks(F.get("parts", F.lit(0)))).alias("first_word"),
        F.when(F.size("parts") > 1, F.col("n_words") - _blanks(F.element_at("parts", -1))).alias("last_word"),
        F.array_compact(F.array(*[F.when(F.col("norm").contains(f" {p} "), F.lit(label)) for p, label in phrases])).alias("base"),
        "held",
        F.when((F.size("held") >= least) & reduce(or_, may), F.col("text")).alias("text"),
    )


def dictionary(rows: list[dict]) -> Column:
    return F.array(*[F.lit(w) for w in sorted({w for r in rows for w in r["words"]})])


def blocks(texts: DataFrame, rows: list[dict]) -> DataFrame:
    """id, block, words, held: for each line, and each window (numbered from -1 down) of twice the words
    of the longest template, its words and those distinct ones that some template has."""
    span = max(r["length"] for r in rows)
    lines = texts.select("id", F.posexplode(F.split("text", "\n")))
    lines = lines.select("id", F.col("pos").alias("block"), F.split(spaced(F.col("col")), " ").alias("words"))
    words = texts.where(F.col("text").contains("\n")).select("id", F.split(spaced(F.col("text")), " ").alias("words"))
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(span))
    windows = words.select("id", F.posexplode(F.transform(starts, lambda i: F.slice("words", i + 1, 2 * span))))
    windows = windows.select("id", (-1 - F.col("pos")).alias("block"), F.col("col").alias("words"))
    return lines.unionByName(windows).select("id", "block", "words", F.array_intersect("words", dictionary(rows)).alias("held"))


def template_rows(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[dict]:
    rows = []
    for number, (label, text) in enumerate(templates):
        words = sorted(set(words_of(text)))
        overlap = math.ceil(threshold * len(words) - 1e-9)
        rows.append({"template": number, "label": label, "words": words, "overlap": overlap, "length": len(words_of(text))})
    return rows


def containment_join(read: DataFrame, rows: list[dict]) -> DataFrame:
    """id, block, template, label, containment: every line and window of every text (see ``read_once``)
    that holds at least ``overlap`` of a template's distinct words."""
    spark = read.sparkSession
    least = min(r["overlap"] for r in rows)
    counted = read.select(F.explode("held").alias("word")).groupBy("word").count()
    order = {r["word"]: r["count"] for r in counted.collect()}  # at most one row per template word
    every = sorted({w for r in rows for w in r["words"]})
    rank = {w: i for i, w in enumerate(sorted(every, key=lambda w: (order.get(w, 0), w)))}
    found = blocks(read.where("text is not null"), rows)

    prefixes = []
    for r in rows:
        ranked = sorted(r["words"], key=rank.get)
        for i, word in enumerate(ranked[: len(ranked) - r["overlap"] + 1]):
            prefixes.append((word, r["template"], r["label"], r["overlap"], i, ranked, r["length"]))
    side = spark.createDataFrame(
        prefixes, "word string, template int, label string, overlap int, t_pos int, t_words array<string>, t_length int"
    )
    # The template's words in the block, in the global order: a translation of ranks to words and back.
    ranks = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    ordered = F.array_sort(F.transform("held", lambda w: F.struct(ranks[w].alias("rank"), w.alias("word"))))
    leads = sorted({p[0] for p in prefixes})
    long_enough = (
        found.where(F.size("held") >= least)
        .where(F.exists("held", lambda w: w.isin(leads)))
        .select("id", "block", "words", ordered.alias("held"))
    )
    tokens = long_enough.select("id", "block", "words", F.col("held.word").alias("b_words"), F.posexplode("held").alias("b_pos", "at"))
    tokens = tokens.select("id", "block", "words", "b_words", "b_pos", F.col("at.word").alias("word")).where(F.col("word").isin(leads))
    paired = tokens.join(F.broadcast(side), "word").where(
        F.least(F.size("t_words") - F.col("t_pos"), F.size("b_words") - F.col("b_pos")) >= F.col("overlap")
    )
    # Of a window only a part counts that is twice as long as this template.
    places = F.sequence(F.lit(1), F.size("words"), F.col("t_length"))
    inside = F.transform(places, lambda i: F.size(F.array_intersect("t_words", F.slice("words", i, 2 * F.col("t_length")))))
    shared = F.when(F.col("block") >= 0, F.size(F.array_intersect("t_words", "b_words"))).otherwise(F.array_max(inside))
    return (
        paired.where(shared >= F.col("overlap"))
        .select("id", "block", "template", "label", (shared / F.size("t_words")).alias("containment"))
        .dropDuplicates(["id", "block", "template"])
    )


def scan(docs: DataFrame, id_col="doc_id", text_col="text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base places and labels, and those of the join."""
    rows = template_rows(templates, threshold)
    base = staged(read_once(docs, id_col, text_col, rows), "texts")
    met = staged(containment_join(base, rows), "licenses").groupBy("id").agg(F.collect_set("label").alias("met"), F.max("containment").alias("best"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("met", F.array().cast("array<string>")))))
    return base.join(met.withColumnRenamed("id", "met_id"), F.col("id").eqNullSafe(F.col("met_id")), "left").select(
        "id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op7(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    """The same by brute force: every line against every template, every word against every phrase."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"('{r['label']}', {quoted(r['words'])}, {r['overlap']})" for r in template_rows())
    words = f"list_filter(regexp_split_to_array(translate({{}}, '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '')"
    at = {
        label: " AND ".join(f"w[i + {k}] = '{word}'" if k else f"w[i] = '{word}'" for k, word in enumerate(phrase.split()))
        for phrase, label in PHRASES
    }
    every = " OR ".join(f"({x})" for x in at.values())
    base = ", ".join(f"CASE WHEN len(list_filter(range(1, len(w) + 1), lambda i: {x})) > 0 THEN '{label}' END" for label, x in at.items())
    return f"""
WITH t(label, words, overlap) AS (VALUES {templates}),
d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, list_filter(range(1, len(w) + 1), lambda i: {every}) AS places,
             list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM d),
lines AS (SELECT doc_id, {words.format("unnest(string_split(coalesce(text, ''), chr(10)))")} AS w FROM documents),
met AS (
  SELECT doc_id, list(DISTINCT label) AS labels,
         max(len(list_intersect(list_distinct(w), words)) / len(words)) AS best
  FROM lines JOIN t ON len(list_intersect(list_distinct(w), words)) >= overlap GROUP BY doc_id)
SELECT doc_id, n_words, CAST(len(places) AS BIGINT) AS n_base,
       places[1] - 1 AS first_word, places[-1] - 1 AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
       greatest(CASE WHEN len(places) > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0)) AS score
FROM p LEFT JOIN met USING (doc_id)
"""


OP7_SQL = _sql()
