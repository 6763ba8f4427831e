"""License scans by diagonal voting.

Every rolling k-gram of words of every text meets the k-grams of known license notices
in an equi join. A meeting votes for its diagonal (place in the text less place in the
template); neighbouring diagonals of one template are merged, so a few inserted or lost
words do not break a span, and a span is verified by the share of the template's k-grams
it holds. The template table is a constant of this module, a few hundred rows.

Base places, phrases of two or three words, are found beside it in each row.

Defined cases: a null text is empty; repeated rows (same doc_id and text) vote once and
each get the same result; a null doc_id is an id like any other; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from opslens.llm.common import let, lower_ascii

K = 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases with their labels, and openings of public license notices.
PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc", "Licensed under CC BY 4.0"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "Licensed under CC BY-SA 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _grams(words: Column) -> Column:
    """Hashes of all runs of K words, by the place of the first."""
    gram = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - K),
                                 lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)]))
    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), gram)
    return F.when(F.size(words) >= K, hashed).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, label, tpos, n_grams) of the constant templates."""
    rows = [(i, label, re.sub(NOT_WORD, " ", notice.lower())) for i, (label, notice) in enumerate(TEMPLATES)]
    table = spark.createDataFrame(rows, "template int, label string, notice string")
    table = table.withColumn("grams", let(F.array_remove(F.split("notice", " "), ""), _grams))
    return table.select("template", "label", F.size("grams").alias("n_grams"),
                        F.posexplode("grams").alias("tpos", "gram"))


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text, and a hash that tells texts of one id apart."""
    return documents.select("doc_id", "text", F.xxhash64(F.col("text").isNull(), "text").alias("text_hash"))


def spans(documents: DataFrame, shift: int = 2, least: float = 0.6) -> DataFrame:
    """(doc_id, text_hash, label, first, last, coverage): verified license spans, in words, last one included.

    ``shift`` is how far two diagonals may lie apart and still be one span; a span
    counts when it holds at least ``least`` of its template's k-grams.
    """
    templates = F.broadcast(template_grams(documents.sparkSession))  # a constant table
    grams = _keyed(documents).select("doc_id", "text_hash", F.posexplode(let(words_of(F.col("text")), _grams)).alias("pos", "gram"))
    meetings = (grams.join(templates, "gram")
                .select("doc_id", "text_hash", "template", "label", "n_grams", "pos", "tpos").distinct())
    votes = (meetings.groupBy("doc_id", "text_hash", "template", "label", "n_grams", (F.col("pos") - F.col("tpos")).alias("diagonal"))
             .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("held")))
    along = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > shift).cast("int"), F.lit(1))
    merged = (votes.withColumn("new", new)
              .withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("doc_id", "text_hash", "template", "label", "n_grams", "run")
              .agg(F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"),
                   F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held")))
    verified = merged.withColumn("coverage", F.col("held") / F.col("n_grams"))
    wide = F.col("last") - F.col("first") + 1 <= 2 * (F.col("n_grams") + K - 1)
    return verified.filter((F.col("coverage") >= least) & wide).select(
        "doc_id", "text_hash", "label", "first", "last", "coverage")


def base_places(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words and the base places, an array of (first word, label), of each row."""
    def places(words: Column) -> Column:
        def of(label: str, phrase: list[str]) -> Column:
            starts = F.filter(F.transform(words, lambda w, i: i), lambda i: _at(words, i, phrase))
            return F.transform(starts, lambda i: F.struct(i.cast("long").alias("i"), F.lit(label).alias("label")))
        return F.concat(*[of(label, phrase) for label, phrase in PHRASES.items()])

    def parts(words: Column) -> Column:
        none = F.array().cast("array<struct<i:bigint,label:string>>")
        return F.struct(F.size(words).cast("long").alias("n_words"),
                        F.when(F.array_contains(words, "license"), places(words)).otherwise(none).alias("places"))

    keyed = _keyed(documents)
    return keyed.select("doc_id", "text_hash", F.explode(F.array(let(words_of(F.col("text")), parts))).alias("p")).select(
        "doc_id", "text_hash", "p.n_words", "p.places")


def _at(words: Column, i: Column, phrase: list[str]) -> Column:
    """Whether the phrase stands at word i; words beyond the end are null and do not match."""
    hit = F.lit(True)
    for j, word in enumerate(phrase):
        hit = hit & F.coalesce(F.get(words, i + j) == word, F.lit(False))
    return hit


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: base places, labels of both kinds, and a score.

    The score is 1 with a base place, else the best coverage of a verified span, else 0.
    """
    base = base_places(documents)
    found = (spans(documents).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
             .agg(F.collect_set("label").alias("voted"), F.max("coverage").alias("coverage"),
                  F.collect_set(F.struct("first", "last", "label")).alias("spans")))
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    starts, labels = F.col("places.i"), F.array_distinct(F.col("places.label"))
    every = F.array_union(labels, F.coalesce("voted", F.array().cast("array<string>")))
    return both.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(every), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
        F.sort_array(F.coalesce("spans", F.array().cast("array<struct<first:int,last:int,label:string>>"))).alias("spans"))


RESULT = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def sql() -> str:
    """The same scan over words instead of hashes, as DuckDB SQL."""
    split = r"list_filter(string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    templates = ", ".join(f"({i}, '{label}', '{notice.lower()}')" for i, (label, notice) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{label}', {phrase})" for label, phrase in PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split.format(fold)} AS w FROM documents),
t AS (SELECT i AS template, label, {split.format("notice")} AS w FROM (VALUES {templates}) v(i, label, notice)),
tg AS (SELECT template, label, len(w) - {K - 1} AS n_grams, unnest(range(1, len(w) - {K - 2})) AS tpos, w FROM t),
tgram AS (SELECT template, label, n_grams, tpos, w[tpos:tpos + {K - 1}] AS gram FROM tg),
dg AS (SELECT r, w, unnest(range(1, len(w) - {K - 2})) AS pos FROM d),
dgram AS (SELECT r, pos, w[pos:pos + {K - 1}] AS gram FROM dg),
votes AS (SELECT r, template, label, n_grams, pos - tpos AS diagonal, min(pos) AS first, max(pos) + {K - 1} AS last, list(tpos) AS held
          FROM dgram JOIN tgram USING (gram) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= 2 THEN 0 ELSE 1 END AS fresh FROM votes WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM marked),
merged AS (SELECT r, label, n_grams, min(first) AS first, max(last) AS last, len(list_distinct(flatten(list(held)))) / n_grams AS coverage
           FROM runs GROUP BY r, template, label, n_grams, run),
voted AS (SELECT r, list(DISTINCT label) AS voted, max(coverage) AS coverage FROM merged
          WHERE coverage >= 0.6 AND last - first + 1 <= 2 * (n_grams + {K - 1}) GROUP BY r),
phrases(label, phrase) AS (VALUES {phrases}),
spots AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE list_contains(w, 'license')),
base AS (SELECT r, count(*) AS n_base, min(p) - 1 AS first_word, max(p) - 1 AS last_word, list(DISTINCT label) AS base
         FROM spots, phrases WHERE w[p:p + len(phrase) - 1] = phrase GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(voted, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(coverage, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN voted USING (r)
"""
