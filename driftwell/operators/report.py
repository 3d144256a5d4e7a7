"""Calibration report and the tables behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.stats import binomial_two_sided, wilson_bounds
from driftwell.operators.ordered import exact_percentiles

WHISKER = 1.5


def calibration_report(metrics: DataFrame, *, n_runs: int, level: float = 0.05, nominal: float | None = None) -> DataFrame:
    """Unshifted rows of (domain, detector, alpha, FPR, AUC_ROC) with the Wilson
    interval and the exact binomial p-value of the false positive count."""
    nominal = level if nominal is None else nominal
    base = metrics.filter(F.col("alpha") == 0)
    if "AUC_ROC" not in base.columns:
        base = base.withColumn("AUC_ROC", F.lit(None).cast("double"))
    counted = base.withColumn("n_fp", F.rint(F.col("FPR") * n_runs).cast("int"))
    low, high = wilson_bounds(F.col("n_fp"), F.lit(n_runs))
    return counted.select(
        "domain",
        "detector",
        "FPR",
        "n_fp",
        low.alias("CI_low_wilson"),
        high.alias("CI_high_wilson"),
        binomial_two_sided(F.col("n_fp"), F.lit(n_runs), nominal).alias("p_binomial"),
        "AUC_ROC",
    )


def tpr_by_alpha(metrics: DataFrame) -> DataFrame:
    """Sensitivity curve, ready to draw."""
    keys = [c for c in ("domain", "detector", "alpha") if c in metrics.columns]
    return metrics.select(*keys, "TPR").orderBy(*keys)


def auc_by_detector(metrics: DataFrame) -> DataFrame:
    """(detector, AUC_TPR), smallest first; the value is the same on all rows of a detector."""
    return metrics.groupBy("detector").agg(F.max("AUC_TPR").alias("AUC_TPR")).orderBy("AUC_TPR", "detector")


def fpr_against_nominal(metrics: DataFrame, *, level: float = 0.05) -> DataFrame:
    """False positive rate without shift beside the nominal level."""
    return metrics.filter(F.col("alpha") == 0).select("detector", "FPR", F.lit(level).alias("nominal"))


def box_statistics(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, n, whisker_low, q1, median, q3, whisker_high, n_outliers); whiskers are
    the extreme values within 1.5 interquartile ranges of the box."""
    quartiles = exact_percentiles(df, groups, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    x = F.col(value).cast("double")
    near = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    return (
        counted.join(quartiles, groups)
        .groupBy(*groups)
        .agg(
            F.sum("_n").alias("n"),
            F.min(F.when(near, x)).alias("whisker_low"),
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.max(F.when(near, x)).alias("whisker_high"),
            F.sum(F.when(near, F.lit(0)).otherwise(F.col("_n"))).alias("n_outliers"),
        )
    )


def unshifted_score_boxes(scores: DataFrame, *, without: list[str] | None = None) -> DataFrame:
    """Box statistics of the alpha = 0 scores per detector, some detectors left out."""
    base = scores.filter(F.col("alpha") == 0)
    if without:
        base = base.filter(~F.col("detector").isin(list(without)))
    return box_statistics(base, ["detector"], "score")


def mean_score_steps(metrics: DataFrame) -> DataFrame:
    """Mean score over alpha, with the falls from one grid point to the next marked."""
    keys = [c for c in ("domain", "detector") if c in metrics.columns]
    order = Window.partitionBy(*keys).orderBy("alpha")
    before = F.lag("mean_score").over(order)
    return metrics.select(
        *keys,
        "alpha",
        "mean_score",
        F.coalesce((F.col("mean_score") < before).cast("int"), F.lit(0)).alias("falls"),
    )
