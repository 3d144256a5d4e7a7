"""The language stage rejects by the classifier's margin."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from driftwell.llm import language


def test_letters_that_are_no_language_go(spark):
    rng = random.Random(4)
    parts = {"xx": ["sha", "ti", "on", "er"], "yy": ["çe", "ou", "é", "aux"], "zz": ["pf", "ge", "ü", "sch"]}
    rows = [(i, " ".join("".join(rng.choices(parts[c], k=3)) for _ in range(30)), c) for i, c in enumerate(list(parts) * 60)]
    short = [(1000, "shation", None), (1001, "schügepf pfge", None), (1002, None, "xx"), (1003, "12 -- 34", "xx")]
    salad = [(2000 + i, "".join(rng.choices("bdfjkmqvwxz ", k=200)), None) for i in range(20)]
    hexes = [(3000 + i, "".join(rng.choices("0123456789abcdef", k=400)), None) for i in range(20)]
    other = [(4000 + i, "".join(rng.choices("абвгдежзик ", k=300)), None) for i in range(20)]
    df = spark.createDataFrame(rows + short + salad + hexes + other, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in language.known_language(df).collect()} == {r[0] for r in rows} | {1000, 1001}


def test_texts_stay_where_there_is_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(i, f"some words {i}", None) for i in range(9)] + [(9, "1 2", None)], "doc_id long, text string, lang string")
    assert language.known_language(df).count() == 9
    one = df.withColumn("lang", F.when(F.col("doc_id") == 0, "en"))
    assert language.known_language(one).count() == 9
