"""License scan by diagonal voting, with DataFrame functions only.

Rolling word k-gram hashes of every text meet the positions of the templates in a join; hits add up by diagonal
(place in the text minus place in the template); a diagonal merges with those up to GAP beyond it, so insertions and
losses do not break a match, and a band's score is the share of the template's words that its spans, verified word by
word, prove. Phrases (short templates) must stand whole on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.session import cut_lineage

#: Words of a k-gram for phrases and for long templates, diagonals that merge, part of a long template to be found.
PHRASE_K, LONG_K, GAP, SHARE = 2, 4, 6, 0.6
#: Words of all templates together: the bound of what is broadcast.
MAX_TEMPLATE_WORDS = 20_000

#: The base phrases and their labels.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
#: Phrases and opening sentences of public licenses; the labels are the method's own.
TEMPLATES = [
    ("agpl", "gnu affero general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("bsd", "bsd license"),
    ("isc", "isc license"),
    ("unlicense", "the unlicense"),
    ("cc0", "cc0 1 0"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by", "creative commons attribution"),
    ("apache-2.0", "apache license version 2 0"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation",
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
        "with this file you can obtain one at",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
_LONG_WORDS = 8


def words_of(text: Column) -> Column:
    """Words after A-Z become a-z: runs of digits, letters and all beyond ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(cut, lambda w: w != "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(hashes: Column, k: int) -> Column:
    """The k-gram hashes of an array of word hashes (a column: it is read for every place), in order."""
    last = F.size(hashes) - k
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)], F.lit(k)))


def hits(k: int, known: list[int]) -> Column:
    """(d_at, hash, gram) of the places of the word array ``w`` (hashes ``wh``) whose k-gram hash is among ``known``."""
    places = F.transform(grams(F.col("wh"), k), lambda h, i: F.struct(i.alias("d_at"), h.alias("hash")))
    found = F.filter(places, lambda g: g["hash"].isin(known))
    return F.transform(found, lambda g: F.struct(g["d_at"].alias("d_at"), g["hash"].alias("hash"), F.slice(F.col("w"), g["d_at"] + 1, F.lit(k)).alias("gram")))


def template_positions(spark: SparkSession, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """(hash, template, label, base, words, at, gram): a row per k-gram of each template."""
    total = sum(len(text.split()) for _, text, _ in templates)
    if total > MAX_TEMPLATE_WORDS:
        raise ValueError(f"the templates have {total} words, more than {MAX_TEMPLATE_WORDS}")
    rows = spark.createDataFrame(
        [(i, label, base, text) for i, (label, text, base) in enumerate(templates)], "template int, label string, base boolean, text string"
    )
    words = rows.withColumn("w", words_of(F.col("text"))).withColumn("wh", word_hashes(F.col("w"))).withColumn("words", F.size("w"))
    out = None
    for k, which in ((PHRASE_K, F.col("words") < _LONG_WORDS), (LONG_K, F.col("words") >= _LONG_WORDS)):
        part = words.filter(which & (F.col("words") >= k)).select(
            "template", "label", "base", "words", F.col("w").alias("all_words"), F.posexplode(grams(F.col("wh"), k)).alias("at", "hash")
        )
        part = part.withColumn("gram", F.slice("all_words", F.col("at") + 1, F.lit(k))).drop("all_words").withColumn("k", F.lit(k))
        out = part if out is None else out.union(part)
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row.

    n_base counts all places of base phrases, first_word and last_word are the least and greatest start (words
    from 0; null without any). Labels are distinct, sorted and joined by commas ("" without any); those of long
    templates need SHARE of the template's words, each counted once, in a band of GAP + 1 diagonals. score is the greatest part found of any
    template that gives a label, 0 without. Null text is empty. Rows stand for themselves: null and repeated keys
    stay, each with its own result.
    """
    spark = docs.sparkSession
    every = [(label, phrase, True) for label, phrase in base] + [(label, phrase, False) for label, phrase in templates]
    table = template_positions(spark, every)
    rows = docs.select(F.col(f"`{key}`").alias("key"), words_of(F.col(f"`{text}`")).alias("w")).select(
        "key", "w", F.size("w").cast("long").alias("n_words"), F.monotonically_increasing_id().alias("row")
    )
    # hashes that no template has (a list bounded by MAX_TEMPLATE_WORDS) make no row; a text is one row of its hits
    known = {k: [] for k in (PHRASE_K, LONG_K)}
    for r in table.select("k", "hash").distinct().collect():
        known[r["k"]].append(r["hash"])
    rows = rows.withColumn("wh", word_hashes(F.col("w")))
    rows = cut_lineage(rows.select("row", "key", "n_words", F.concat(*[hits(k, v) for k, v in known.items() if v]).alias("hits")))
    votes = (
        rows.select("row", F.explode("hits").alias("g"))
        .select("row", "g.*")
        .join(F.broadcast(table.withColumnRenamed("gram", "own")), "hash")
        .filter(F.col("gram") == F.col("own"))
        .groupBy("row", "template", "label", "base", "words", "k", (F.col("d_at") - F.col("at")).alias("line"))
        .agg(F.count("at").alias("votes"), F.collect_set("at").alias("at"))
    )
    votes = cut_lineage(votes)
    phrases = (
        votes.filter((F.col("words") < _LONG_WORDS) & (F.col("votes") == F.col("words") - F.col("k") + 1))
        .groupBy("row", "label", "base")
        .agg(F.count("*").alias("places"), F.min("line").alias("first"), F.max("line").alias("last"))
        .withColumn("score", F.lit(1.0))
    )
    # a band is a diagonal and those up to GAP beyond it; a template's word counts once, however many places prove it
    band = Window.partitionBy("row", "template").orderBy("line").rangeBetween(0, GAP)
    long = votes.filter(F.col("words") >= _LONG_WORDS).withColumn("at", F.array_distinct(F.flatten(F.collect_list("at").over(band))))
    proved = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + F.col("k") - 1))))
    long = (
        long.withColumn("part", F.size(proved) / F.col("words"))
        .filter(F.col("part") >= SHARE)
        .groupBy("row", "label")
        .agg(F.max("part").alias("score"))
        .select("row", "label", F.lit(False).alias("base"), F.lit(0).cast("long").alias("places"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), "score")
    )
    found = phrases.select("row", "label", "base", "places", "first", "last", "score").union(long)
    found = found.groupBy("row").agg(
        F.sum(F.when(F.col("base"), F.col("places"))).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("last"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    return rows.join(found, "row", "left").select(
        F.col("key").alias(key), "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    """Templates looked up word by word. Long ones are found whole or not at all here: see the tests for parts."""
    known = [(label, phrase, True) for label, phrase in BASE] + [(label, phrase, False) for label, phrase in TEMPLATES]
    values = ", ".join(f"('{label}', '{phrase}', {base})" for label, phrase, base in known)
    return rf"""
WITH words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
templates AS (SELECT label, string_split(phrase, ' ') AS p, base FROM (VALUES {values}) t(label, phrase, base)),
places AS (
  SELECT doc_id, label, base, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS pos
  FROM words, templates WHERE list_has_all(w, p)),
found AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(pos) FILTER (WHERE base) AS first_word, max(pos) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN labels IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS score
FROM words LEFT JOIN found USING (doc_id)
"""


SQL = _sql()


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
