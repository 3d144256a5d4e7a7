"""Resample counters that are joined before they are made long, and words left out before a shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import columns as C
from driftwell.operators import resample as S
from driftwell.sources import text as T

ALPHAS, RUNS = [0.0, 0.3, 1.0], 5


def pool(spark):
    return spark.range(200).select(
        F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 5 == 0, "p").otherwise("q").alias("c")
    )


def test_counters_are_the_weights(spark):
    rows = pool(spark)
    counted = S.subgroup_shift_counters(rows, F.col("c") == "p", ALPHAS, n_runs=RUNS, seed=3)
    assert counted.columns == ["run", "row_id", "w0", "w1", "w2"]
    joined = S.long_weights(counted.join(rows, "row_id"), ALPHAS)
    weights = S.subgroup_shift_weights(rows, F.col("c") == "p", ALPHAS, n_runs=RUNS, seed=3).join(rows, "row_id")
    columns = ["alpha", "run", "row_id", "x", "c", "w"]
    assert sorted(joined.select(columns).collect()) == sorted(weights.select(columns).collect())
    assert joined.agg(F.sum("w")).first()[0] == 200 * len(ALPHAS) * RUNS


def test_statistics_from_counters(spark):
    """Fifteen resamples: several runs a chunk, the last chunk not full; two pool rows share a key."""
    rows = pool(spark).withColumn("row_id", F.when(F.col("row_id") == 1, 0).otherwise(F.col("row_id"))).cache()
    reference = rows.filter("row_id >= 90")
    counted = S.subgroup_shift_counters(rows, F.col("c") == "p", ALPHAS, n_runs=RUNS, seed=3)
    drawn = C.drawn_counters(rows, counted, ALPHAS, RUNS, ["x", "c"])
    weights = S.subgroup_shift_weights(rows, F.col("c") == "p", ALPHAS, n_runs=RUNS, seed=3)
    assert drawn.chunks == 3
    for found in (
        lambda w: C.ks_by_column(reference, rows, ["x"], w),
        lambda w: C.jensen_shannon_by_column(reference, rows, ["c"], w),
        lambda w: C.column_drift(reference, rows, w),
    ):
        one, other = ([r.asDict() for r in found(w).orderBy("alpha", "run", "column").collect()] for w in (drawn, weights))
        assert len(one) in (15, 30) and one == other


def test_terms_are_chosen_before_documents_are_counted(spark):
    docs = spark.createDataFrame([(1, "aa aa bb cc"), (2, "bb dd dd dd"), (None, "cc bb"), (1, "aa")], "row_id long, text string")
    terms = T.frequent_terms(docs, max_features=3)
    assert {r["term"] for r in terms.collect()} == {"aa", "bb", "dd"}
    counts = T.tokens(docs, terms=terms)
    assert sorted((r["row_id"] or 0, r["term"], r["tf"]) for r in counts.collect()) == [(0, "bb", 1), (1, "aa", 3), (1, "bb", 1), (2, "bb", 1), (2, "dd", 3)]
    full = T.vocabulary(T.tokens(docs), 4, max_features=3)
    assert sorted(T.vocabulary(counts, 4, max_features=3).collect()) == sorted(full.collect())
