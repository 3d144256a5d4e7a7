from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators.ordered import exact_percentiles, running_totals
from driftwell.operators.resample import alpha_key
from driftwell.sources.results import read_domain_metrics
from driftwell.sources.series import assemble_series


def test_metrics_go_by_header_name(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "part.csv").write_text("FPR,detector,alpha,TPR\n0.1,a,0.5,0.9\n")
    row = read_domain_metrics(spark, {"d": str(folder), "gone": str(tmp_path / "none")}).first()
    assert (row["detector"], row["alpha"], row["TPR"], row["FPR"], row["AUC_ROC"], row["domain"]) == ("a", 0.5, 0.9, 0.1, None, "d")


def test_series_keys_of_different_entities_differ(spark):
    rows = [("a|b", "c", "2024-01-01", 1.0), ("a", "b|c", "2024-01-01", 2.0), (None, "c", "2024-01-02", 3.0), ("", "c", "2024-01-02", 4.0), ("a\\", "|c", "2024-01-01", 5.0)]
    events = spark.createDataFrame(rows, "x string, y string, t string, v double")
    found = assemble_series(events, ["x", "y"], time="t", value="v", start="2024-01-01", length=2).collect()
    assert len({r["row_id"] for r in found}) == 5


def test_percentiles_leave_nan_and_null_out(spark):
    df = spark.createDataFrame([(x,) for x in (-5.0, 1.0, 2.0, 3.0, math.nan, None)], "x double")
    row = exact_percentiles(df, [], "x", {"low": 0.0, "mid": 0.5, "high": 1.0}).first()
    assert (row["low"], row["mid"], row["high"]) == (-5.0, 1.5, 3.0)


def test_infinities_and_nan_keep_their_order(spark):
    values = [-math.inf, -1e300, 0.0, 1e300, math.inf, math.nan]
    df = spark.createDataFrame([(x, 1) for x in values], "x double, n int")
    found = {repr(r["x"]): r["n_before"] for r in running_totals(df, [], "x", ["n"]).collect()}
    assert found == {repr(x): i for i, x in enumerate(values)}


@pytest.mark.parametrize("alpha", [0.00004, 0.00025])
def test_alpha_beyond_four_decimals_is_refused(alpha):
    with pytest.raises(ValueError, match="decimals"):
        alpha_key(alpha)


def test_buckets_follow_the_values(spark):
    """Narrow bands far from zero, ties, infinities and NaN: no bucket holds over 1 % of the distinct values."""
    from driftwell.operators.ordered import bucketed

    x = F.when(F.col("id") < 90_000, F.lit(1.7e9) + F.col("id")).when(F.col("id") < 99_000, F.lit(-1e-9) * F.col("id"))
    x = x.when(F.col("id") < 99_990, 10.0 ** (F.col("id") % 300)).when(F.col("id") < 99_995, float("inf")).otherwise(float("nan"))
    values = spark.range(100_000).select(x.alias("x")).distinct()
    rows = bucketed(values, "x")
    total = rows.count()
    assert rows.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 0.01 * total
    ranges = rows.groupBy("_bucket").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("_bucket").collect()
    assert all(a["high"] < b["low"] or str(b["low"]) == "nan" for a, b in zip(ranges, ranges[1:]))
    assert bucketed(values.filter("x IS NULL"), "x").count() == 0


def test_percentiles_of_seconds(spark):
    df = spark.range(50_000).select((F.lit(1.7e9) + F.col("id") % 20_000).alias("x"), (F.col("id") % 3).alias("g"))
    got = {r["g"]: (r["low"], r["mid"]) for r in exact_percentiles(df, ["g"], "x", {"low": 0.01, "mid": 0.5}).collect()}
    for g in range(3):
        own = np.array([1.7e9 + i % 20_000 for i in range(50_000) if i % 3 == g])
        assert got[g] == tuple(np.percentile(own, [1, 50]))
