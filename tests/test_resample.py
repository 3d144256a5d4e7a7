from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftwell.operators import numbering as N
from driftwell.operators import resample as S


@pytest.fixture(scope="module")
def pool(spark):
    return spark.createDataFrame([(i, "ab"[i % 3 == 0], i % 3 == 0) for i in range(50)], "row_id bigint, label string, sub boolean")


def md5(*parts) -> str:
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def expected_draws(members: list[int], group: str, seed: int, n: int) -> Counter:
    order = sorted(members, key=lambda i: (md5("rows", i), i))
    return Counter(order[int(int(md5(seed, group, d)[:13], 16) / 16.0**13 * len(order))] for d in range(n))


def test_numbers_are_dense_within_groups(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(1000)], "row_id bigint, g string")
    got: dict[str, list[int]] = {}
    for r in N.number_rows(rows, "row_id", ["g"]).collect():
        got.setdefault(r["g"], []).append(r["rn"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.5, 1.0])
def test_split_is_exact(spark, fraction):
    rows = spark.range(777).withColumnRenamed("id", "row_id")
    got = [r["row_id"] for r in N.split_by_fraction(rows, "row_id", fraction, seed=7).filter("is_reference").collect()]
    want = sorted(range(777), key=lambda i: (md5(7, "split", i), i))[: int(fraction * 777)]
    assert sorted(got) == sorted(want)


def test_sample_without_replacement(spark):
    rows = spark.range(100).withColumnRenamed("id", "row_id")
    got = [r["row_id"] for r in N.sample_rows(rows, "row_id", 10, seed=1, tag="t").collect()]
    assert got == sorted(range(100), key=lambda i: md5(1, "t", i))[:10]
    assert N.sample_rows(rows, "row_id", 1000, seed=1, tag="t").count() == 100


def test_mixture_counts_round_half_to_even():
    assert S.mixture_counts({"a": 4, "b": 1}, [0.0, 0.1, 0.3, 0.5, 1.0]) == {"a": [5, 5, 3, 3, 0], "b": [0, 0, 2, 2, 5]}


def test_subgroup_counts_start_at_the_pool_share():
    assert S.subgroup_counts({"a": 8, "b": 2}, [0.0, 0.5, 1.0]) == {"a": [8, 4, 0], "b": [2, 6, 10]}


def test_mixture_weights_equal_the_drawn_rows(spark, pool):
    got: dict = {}
    for r in S.class_mixture_weights(pool, "label", "a", "b", [0.0, 0.5, 1.0], n_runs=2, seed=42).collect():
        got.setdefault((float(r["alpha"]), r["run"]), Counter())[r["row_id"]] = r["w"]
    a, b = [i for i in range(50) if i % 3], [i for i in range(50) if i % 3 == 0]
    for alpha, n_b in ((0.0, 0), (0.5, 25), (1.0, 50)):
        for run in (0, 1):
            want = expected_draws(a, "a", 42 + run, 50 - n_b) + expected_draws(b, "b", 42 + run, n_b)
            assert got[alpha, run] == want


def test_every_resample_has_the_pool_size_and_exact_shares(spark, pool):
    drawn = S.subgroup_shift_weights(pool, F.col("sub"), [0.0, 0.37, 1.0], n_runs=3).join(pool, "row_id")
    rows = drawn.groupBy("alpha", "run").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("sub"), F.col("w")).otherwise(0)).alias("k")).collect()
    assert len(rows) == 9
    for r in rows:
        base = 17 / 50
        assert r["n"] == 50 and r["k"] == round((base + float(r["alpha"]) * (1 - base)) * 50)


def test_subgroup_missing_falls_back_to_the_whole_pool(spark, pool):
    drawn = S.subgroup_shift_weights(pool, F.col("label") == "zzz", [0.0, 1.0], n_runs=1)
    got = {float(r["alpha"]): r["n"] for r in drawn.groupBy("alpha").agg(F.sum("w").alias("n")).collect()}
    assert got == {0.0: 50, 1.0: 50}


def test_null_predicate_is_outside(spark):
    rows = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "row_id bigint, c string")
    drawn = S.subgroup_shift_weights(rows, F.col("c") == "x", [1.0], n_runs=1)
    assert {r["row_id"] for r in drawn.collect()} == {2}


@pytest.mark.parametrize("alpha", [-0.1, 1.1])
def test_alpha_outside_the_unit_interval(spark, pool, alpha):
    with pytest.raises(ValueError, match="alpha must be in"):
        S.class_mixture_weights(pool, "label", "a", "b", [alpha], n_runs=1)


def test_close_alphas_stay_apart(spark, pool):
    drawn = S.class_mixture_weights(pool, "label", "a", "b", [0.005, 0.01, 0.015], n_runs=1)
    assert drawn.select("alpha").distinct().count() == 3
