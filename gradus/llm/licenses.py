"""License notices by diagonal voting over word pairs; DataFrame functions only.

Every rolling pair of words is joined with the places at which license
templates have the same pair. A hit votes for a diagonal (place in the text
minus place in the template); neighbouring diagonals are merged, so a few
inserted or missing words do no harm, and a merged span is verified by the
share of the template's pairs that it holds. The templates are a fixed short
table, which is why it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.common import ascii_lower

# The base phrases with their labels.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Opening words of common license notices.
NOTICES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: diagonals this far apart are merged
GAP = 2
#: share of a notice's word pairs that a span must hold
LEAST_SHARE = 0.8


def template_pairs() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, is a base phrase, its pairs, place, word, next word)."""
    out = []
    for t, (label, text) in enumerate(BASE + NOTICES):
        words = text.split()
        out += [(t, label, t < len(BASE), len(words) - 1, p, a, b) for p, (a, b) in enumerate(zip(words, words[1:]))]
    return out


def pair_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document one row of its number of words (template null), and a row for each word pair that stands in a template."""
    spark: SparkSession = docs.sparkSession
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), SEPARATORS), "")
    listed = docs.select(F.col(id_col).alias("doc_id"), words.alias("w")).withColumn("row", F.monotonically_increasing_id())
    pairs = listed.select("row", "doc_id", F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("pos", "pair"))
    pairs = pairs.select("row", "doc_id", "pos", "pair.a", "pair.b")
    fields = "template int, label string, base boolean, pairs int, place int, ta string, tb string"
    known = spark.createDataFrame(template_pairs(), fields).withColumn("code", F.xxhash64("ta", "tb"))
    same = (F.xxhash64("a", "b") == F.col("code")) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb"))
    # a text's last word has no next one and stands for the document; a text without words gives one empty row
    hits = pairs.join(F.broadcast(known), same, "left").filter("b is null or template is not null")
    return hits.select("row", "doc_id", F.when(F.col("b").isNull(), F.coalesce(F.col("pos") + 1, F.lit(0))).alias("n_words"), "template", "label", "base", "pairs", "place", (F.col("pos") - F.col("place")).alias("diagonal"))


def spans(hits: DataFrame) -> DataFrame:
    """Merged diagonals: template, first diagonal, share of the template's pairs on it, exact (all pairs on one diagonal)."""
    rows = ["row", "template", "label", "base", "pairs"]
    vote = F.bit_or(F.when(F.col("place").isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))))
    by_diagonal = hits.groupBy(*rows, "diagonal").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), vote.alias("held"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    # full base phrases are never merged: each is a place of its own
    fresh = (F.col("diagonal") - F.lag("diagonal").over(along) <= GAP) & ~F.col("base")
    chained = by_diagonal.withColumn("new", F.when(fresh, 0).otherwise(1)).withColumn("chain", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = chained.groupBy(*rows, "chain").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.min("diagonal").alias("start"), F.bit_or("held").alias("held")
    )
    return merged.withColumn("share", F.bit_count("held") / F.col("pairs"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License phrases and notices of every document.

    Returns a row per input row: doc_id, n_words, n_base (places of the base
    phrases), first_word and last_word (smallest and largest start of these),
    base_labels, labels (those of verified notices too), score (largest share
    of a template that a span holds). Words are runs of ASCII letters in lower
    case, digits and characters beyond ASCII. A null text equals an empty one:
    no words, score 0. Repeated rows and null ids give rows of their own.
    """
    placed = pair_hits(docs, id_col, text_col).repartition("row")  # the only shuffle: all that follows goes by row
    found = spans(placed)
    exact = F.col("base") & (F.col("share") == 1)
    shown = exact | (~F.col("base") & (F.col("share") >= LEAST_SHARE))
    best = F.when(F.col("base"), F.when(exact, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.col("share"))
    joined = lambda which: F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")
    out = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"),
        F.count_if(exact).alias("n_base"), F.min(F.when(exact, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("start"))).cast("long").alias("last_word"), joined(exact).alias("base_labels"),
        joined(shown).alias("labels"), F.coalesce(F.max(best), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")


def license_sql() -> str:
    """The same scan as SQL over ``documents``."""
    values = ", ".join(f"({t}, '{label}', {str(base).lower()}, {n}, {p}, '{a}', '{b}')" for t, label, base, n, p, a, b in template_pairs())
    return rf"""
    WITH known(template, label, base, pairs, place, ta, tb) AS (VALUES {values}),
    w AS (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
    p AS (SELECT r, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w),
    hits AS (SELECT r, template, label, base, pairs, place, i - 1 - place AS diagonal FROM p JOIN known ON w[i] = ta AND w[i + 1] = tb),
    d AS (SELECT r, template, label, base, pairs, diagonal, bit_or(1::BIGINT << place) AS held FROM hits GROUP BY ALL),
    c AS (SELECT *, CASE WHEN NOT base AND diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM d),
    e AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS chain FROM c),
    s AS (SELECT r, label, base, min(diagonal) AS start, bit_count(bit_or(held)) / pairs AS share FROM e GROUP BY r, template, label, base, pairs, chain),
    g AS (SELECT r, count(*) FILTER (base AND share = 1) AS n_base, min(start) FILTER (base AND share = 1) AS first_word,
        max(start) FILTER (base AND share = 1) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND share = 1) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND share = 1 OR NOT base AND share >= {LEAST_SHARE}) AS labels,
        max(CASE WHEN NOT base THEN share WHEN share = 1 THEN 1.0 ELSE 0.0 END) AS score FROM s GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM w LEFT JOIN g USING (r)"""
