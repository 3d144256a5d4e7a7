"""Stages 2 and 3 of the pipeline judge rows, whatever their doc_id."""

from __future__ import annotations

import random

import corpus_pipeline


def test_rows_without_or_with_shared_ids(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (1, c), (1, c), (1, d), (2, a), (3, e), (None, None), (None, e)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] or 0, r[1] or "")
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(kept, key=key) == sorted([(None, b), (1, c), (1, d), (2, a), (3, e), (None, None)], key=key)
    f = text()
    rows = [(1, a), (2, f), (2, "zz " + a), (None, b), (None, b), (2, f)]
    cut = [tuple(r) for r in corpus_pipeline.repeated_substrings(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(cut, key=key) == sorted([(1, a), (2, f), (2, "zz"), (None, b), (None, ""), (2, "")], key=key)
