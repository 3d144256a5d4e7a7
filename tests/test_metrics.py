from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import metrics as M
from driftwell.operators import report as R
from driftwell.operators.ordered import exact_percentiles, running_totals

SCHEMA = "detector string, alpha decimal(6,4), run int, score double"


def cube(spark, grid: dict[str, dict[float, list[float]]]):
    from decimal import Decimal

    rows = [
        (d, Decimal(str(a)), i, float(s)) for d, by in grid.items() for a, scores in by.items() for i, s in enumerate(scores)
    ]
    return spark.createDataFrame(rows, SCHEMA)


# the threshold is 0.555, so one, two and four of four scores are flagged
SMALL = {"small": {0.0: [0.3, 0.1, 0.6, 0.2], 0.4: [0.5, 0.7, 0.2, 0.9], 1.0: [0.8, 0.9, 0.75, 0.7]}}


def test_threshold_is_the_interpolated_percentile(spark):
    x = np.random.default_rng(0).normal(size=1000)
    got = M.thresholds(cube(spark, {"d": {0.0: list(x)}})).first()["threshold"]
    assert got == pytest.approx(np.percentile(x, 95), abs=1e-12)


def test_constant_scores(spark):
    got = M.thresholds(cube(spark, {"d": {0.0: [0.5] * 100}})).first()["threshold"]
    assert got == 0.5


def test_percentiles_with_a_hot_value_and_signs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(scale=1e4, size=700), np.full(400, 3.25), -rng.exponential(1e-4, 300), [0.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = exact_percentiles(df, [], "x", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}).first()
    assert list(got) == pytest.approx(list(np.percentile(x, [0, 25, 50, 99, 100])), rel=1e-12)


def test_running_totals(spark):
    x = np.random.default_rng(2).integers(-50, 50, 500)
    df = spark.createDataFrame([("g", float(v), 2) for v in x], "g string, x double, n int")
    rows = {r["x"]: r for r in running_totals(df, ["g"], "x", ["n"], following=True).collect()}
    distinct = sorted(set(map(float, x)))
    for v, nxt in zip(distinct, [*distinct[1:], None]):
        assert (rows[v]["n"], rows[v]["n_before"], rows[v]["n_all"]) == (2 * (x == v).sum(), 2 * (x < v).sum(), 1000)
        assert rows[v]["following"] == nxt


def test_metrics_of_a_small_cube(spark):
    rows = {float(r["alpha"]): r for r in M.detection_metrics(cube(spark, SMALL)).collect()}
    assert rows[0.4]["TPR"] == 0.5 and rows[0.4]["FPR"] == 0.5
    assert rows[0.0]["TPR"] == 0.0 and rows[0.0]["FPR"] == 0.25
    assert rows[0.0]["TNR"] == 0.75
    assert rows[1.0]["AUC_TPR"] == pytest.approx(0.4 * 0.25 + 0.6 * 0.75)
    assert rows[1.0]["alpha_at_80_tpr"] == 1.0 and rows[1.0]["tpr_at_alpha_05"] == pytest.approx(0.5 + 0.5 / 6)
    assert rows[1.0]["AUC_ROC"] == pytest.approx(28.5 / 32)
    for r in rows.values():
        assert r["F1"] == r["Precision"]


def test_nothing_flagged(spark):
    held_out = spark.createDataFrame([("d", 0, 9.0)], "detector string, run int, score double")
    rows = {float(r["alpha"]): r for r in M.detection_metrics(cube(spark, {"d": {0.0: [0.1], 1.0: [0.2, 0.3]}}), held_out).collect()}
    assert (rows[1.0]["TPR"], rows[1.0]["FPR"], rows[1.0]["alpha_at_80_tpr"]) == (0.0, 1.0, None)


def test_detector_without_unshifted_scores_is_left_out(spark):
    assert M.detection_metrics(cube(spark, {"only": {0.3: [0.4, 0.65, 0.7]}})).count() == 0


def test_alpha_without_scores_is_skipped(spark):
    assert M.detection_metrics(cube(spark, {"gap": {0.0: [0.25, 0.35, 0.3], 0.7: []}})).count() == 1


def test_single_point_has_no_area(spark):
    row = M.detection_metrics(cube(spark, {"one": {0.0: [0.4, 0.45, 0.05]}})).first()
    assert (row["AUC_TPR"], row["tpr_at_alpha_05"], row["AUC_ROC"]) == (0.0, 0.0, 0.5)


def test_half_is_interpolated_and_clamped(spark):
    curve = spark.createDataFrame(
        [("a", 0.0, 0.0), ("a", 0.4, 0.2), ("a", 0.8, 0.6), ("b", 0.0, 0.0), ("b", 0.3, 0.7), ("c", 0.6, 0.9), ("c", 1.0, 1.0)],
        "detector string, alpha double, TPR double",
    ).withColumn("FPR", F.lit(0.0))
    got = {r["detector"]: r["tpr_at_alpha_05"] for r in M.curve_summary(curve).collect()}
    assert got == {"a": pytest.approx(0.3), "b": pytest.approx(0.7), "c": pytest.approx(0.9)}


def test_auc_of_separate_and_tied_scores(spark):
    scores = cube(spark, {"apart": {0.0: [-2.0, 1.5, 0.0], 0.6: [3.0, 1.75]}, "tied": {0.0: [7.0] * 3, 0.6: [7.0]}})
    assert {r["detector"]: r["AUC_ROC"] for r in M.auc_roc(scores).collect()} == {"apart": 1.0, "tied": 0.5}


def test_auc_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    neg, pos = rng.integers(0, 9, 60), rng.integers(2, 12, 40)
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    got = M.auc_roc(cube(spark, {"d": {0.0: list(neg), 0.7: list(pos)}})).first()["AUC_ROC"]
    assert got == pytest.approx(want, abs=1e-12)


# published counts of 100 runs and what follows from them
REPORT = [(0, 0.0, 0.03699, 0.0101947), (16, 0.10095, 0.24420, 3.705e-05)]


@pytest.mark.parametrize("n_fp, low, high, p", REPORT)
def test_calibration_report(spark, n_fp, low, high, p):
    rows = spark.createDataFrame([("dom", "d", 0.0, n_fp / 100, 0.9)], "domain string, detector string, alpha double, FPR double, AUC_ROC double")
    got = R.calibration_report(rows, n_runs=100).first()
    assert got["n_fp"] == n_fp
    assert got["CI_low_wilson"] == pytest.approx(low, abs=1e-5)
    assert got["CI_high_wilson"] == pytest.approx(high, abs=1e-5)
    assert got["p_binomial"] == pytest.approx(p, rel=1e-3)


def test_binomial_p_against_direct_sum(spark):
    from math import comb

    rows = spark.createDataFrame([("x", str(k), 0.0, k / 37) for k in range(38)], "domain string, detector string, alpha double, FPR double")
    got = {r["n_fp"]: r for r in R.calibration_report(rows, n_runs=37, level=0.2).collect()}
    pmf = [comb(37, k) * 0.2**k * 0.8 ** (37 - k) for k in range(38)]
    for k in range(38):
        assert got[k]["p_binomial"] == pytest.approx(min(1, sum(q for q in pmf if q <= pmf[k] * (1 + 1e-7))), rel=1e-9)
        assert got[k]["AUC_ROC"] is None


def test_box_statistics(spark):
    x = [1.0, 2.0, 3.0, 4.0, 100.0]
    row = R.box_statistics(spark.createDataFrame([("g", v) for v in x], "g string, x double"), ["g"], "x").first()
    assert (row["n"], row["q1"], row["median"], row["q3"]) == (5, 2.0, 3.0, 4.0)
    assert (row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (1.0, 4.0, 1)


def test_mean_score_steps(spark):
    rows = spark.createDataFrame([("d", 0.0, 1.0), ("d", 0.5, 0.4), ("d", 1.0, 2.0)], "detector string, alpha double, mean_score double")
    assert [r["falls"] for r in R.mean_score_steps(rows).orderBy("alpha").collect()] == [0, 1, 0]
