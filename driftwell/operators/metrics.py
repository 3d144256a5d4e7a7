"""Detection quality from scores: thresholds, rates, curves and areas.

Scores are rows (detector, alpha, run, score). Per-detector tables have one row
per configured detector, a number that does not grow with the data, so they are
joined by broadcast; everything computed over scores is a partial aggregation or
a running total spread over value buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.ordered import exact_percentiles, running_totals

HALF = 0.5
#: Resamples whose weights share a row.
SLOTS = 8
TARGET_TPR = 0.8
EXPORT_NAMES = {"alpha_at_80_tpr": "alpha@80%TPR", "tpr_at_alpha_05": "TPR@alpha=0.5"}


def thresholds(scores: DataFrame, calibration: DataFrame | None = None, *, significance: float = 0.05) -> DataFrame:
    """(detector, threshold): the upper percentile of the calibration scores, or of
    the unshifted scores for a detector that was not calibrated."""
    own = scores.filter(F.col("alpha") == 0).select("detector", "score", F.lit("own").alias("kind"))
    if calibration is not None:
        own = own.unionByName(calibration.select("detector", "score", F.lit("held_out").alias("kind")))
    cut = exact_percentiles(own, ["detector", "kind"], "score", {"cut": 1.0 - significance})
    picked = cut.groupBy("detector").agg(
        F.max(F.when(F.col("kind") == "held_out", F.col("cut"))).alias("held_out"),
        F.max(F.when(F.col("kind") == "own", F.col("cut"))).alias("own"),
    )
    return picked.filter(F.col("own").isNotNull()).select(
        "detector", F.coalesce("held_out", "own").alias("threshold")
    )


def flag_rates(scores: DataFrame, threshold: DataFrame) -> DataFrame:
    """(detector, alpha, n, flag_rate, mean_score, std_score); flagged means strictly above."""
    judged = scores.join(F.broadcast(threshold), "detector")
    return judged.groupBy("detector", "alpha").agg(
        F.count("*").alias("n"),
        F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("flag_rate"),
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
    )


def tpr_curve(rates: DataFrame) -> DataFrame:
    """Rates per (detector, alpha). The unshifted row has no true positives: its
    flagged share is the false positive rate. For a shifted row ``FPR`` is the
    share not flagged, and ``Precision`` and ``F1`` equal the flagged share."""
    flagged = F.col("flag_rate")
    unshifted = F.col("alpha") == 0
    return rates.select(
        "detector",
        "alpha",
        F.when(unshifted, F.lit(0.0)).otherwise(flagged).alias("TPR"),
        F.when(unshifted, flagged).otherwise(F.lit(1.0) - flagged).alias("FPR"),
        flagged.alias("Precision"),
        flagged.alias("F1"),
        "mean_score",
        "std_score",
    )


def _interpolated(at: float) -> Column:
    """TPR at one alpha, linear between the grid points around it, flat outside."""
    a = F.col("alpha").cast("double")
    point = F.struct(a.alias("a"), F.col("TPR").alias("t"))
    below = F.max(F.when(a <= at, point))
    above = F.min(F.when(a >= at, point))
    share = (F.lit(at) - below["a"]) / (above["a"] - below["a"])
    return (
        F.when(below.isNull(), above["t"])
        .when(above.isNull(), below["t"])
        .when(above["a"] == below["a"], below["t"])
        .otherwise(below["t"] + (above["t"] - below["t"]) * share)
    )


def curve_summary(curve: DataFrame) -> DataFrame:
    """(detector, TNR, AUC_TPR, alpha_at_80_tpr, tpr_at_alpha_05) from a TPR curve."""
    by_alpha = Window.partitionBy("detector").orderBy("alpha")
    a = F.col("alpha").cast("double")
    stepped = curve.withColumn("_da", a - F.lag(a).over(by_alpha)).withColumn(
        "_mid", (F.col("TPR") + F.lag("TPR").over(by_alpha)) / 2
    )
    enough = F.count("*") > 1
    return stepped.groupBy("detector").agg(
        F.max(F.when(F.col("alpha") == 0, F.lit(1.0) - F.col("FPR"))).alias("TNR"),
        F.when(enough, F.sum(F.col("_mid") * F.col("_da")) / (F.max(a) - F.min(a)))
        .otherwise(F.lit(0.0))
        .alias("AUC_TPR"),
        F.min(F.when((F.col("alpha") > 0) & (F.col("TPR") >= TARGET_TPR), a)).alias("alpha_at_80_tpr"),
        F.when(enough, _interpolated(HALF)).otherwise(F.lit(0.0)).alias("tpr_at_alpha_05"),
    )


def auc_roc(
    scores: DataFrame, groups: list[str] | None = None, *, positive: Column | None = None, weight: str | None = None
) -> DataFrame:
    """(groups, AUC_ROC): chance that a shifted score exceeds an unshifted one, ties
    counting one half; 0.5 when only one kind is present."""
    groups = groups or ["detector"]
    positive = F.col("alpha") > 0 if positive is None else positive
    w = (F.col(weight) if weight else F.lit(1)).cast("bigint")
    kinds = scores.select(
        *groups,
        "score",
        F.when(positive, w).otherwise(F.lit(0)).alias("pos"),
        F.when(positive, F.lit(0)).otherwise(w).alias("neg"),
    )
    totals = running_totals(kinds, groups, "score", ["pos", "neg"])
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    pairs = F.max("pos_all").cast("double") * F.max("neg_all")
    return totals.groupBy(*groups).agg(F.when(pairs > 0, won / pairs).otherwise(F.lit(0.5)).alias("AUC_ROC"))


def detection_metrics(
    scores: DataFrame, calibration: DataFrame | None = None, *, significance: float = 0.05
) -> DataFrame:
    """All metrics per (detector, alpha); a detector without unshifted scores is left out."""
    cut = thresholds(scores, calibration, significance=significance)
    curve = tpr_curve(flag_rates(scores, cut))
    overall = curve_summary(curve).join(auc_roc(scores), "detector")
    return curve.join(F.broadcast(overall), "detector").select(
        "detector",
        "alpha",
        "TPR",
        "FPR",
        "Precision",
        "F1",
        "mean_score",
        "std_score",
        "TNR",
        "AUC_TPR",
        "alpha_at_80_tpr",
        "tpr_at_alpha_05",
        "AUC_ROC",
    )


def finished_metrics(
    scores: DataFrame, finished: DataFrame, calibration: DataFrame | None = None, *, significance: float = 0.05
) -> DataFrame:
    """The same metrics over the intensities already finished (detector, alpha)."""
    done = scores.join(F.broadcast(finished.select("detector", "alpha").distinct()), ["detector", "alpha"])
    return detection_metrics(done, calibration, significance=significance)


def auc_interval(
    scores: DataFrame, draws: DataFrame, *, row_id: str = "row_id", level: float = 0.95
) -> DataFrame:
    """(detector, auc_low, auc_high): percentile interval of AUC_ROC over bootstrap
    resamples ``draws`` (run, row_id, w). Resamples with one kind only do not count.

    One row holds the weights of up to ``SLOTS`` resamples, so scores are joined, added up
    and sorted once per chunk of resamples; every running total is one number a slot.
    """
    chunk, slot = F.floor(F.col("run") / SLOTS), F.pmod(F.col("run"), F.lit(SLOTS))
    weights = [F.sum(F.when(slot == i, F.col("w")).otherwise(0)).alias(f"w{i}") for i in range(SLOTS)]
    drawn = scores.join(draws.groupBy(row_id, chunk.alias("chunk")).agg(*weights), row_id)
    shifted = F.col("alpha") > 0
    kinds = drawn.select(
        "chunk",
        "detector",
        "score",
        *[F.when(shifted, F.col(f"w{i}")).otherwise(0).alias(f"pos{i}") for i in range(SLOTS)],
        *[F.when(shifted, 0).otherwise(F.col(f"w{i}")).alias(f"neg{i}") for i in range(SLOTS)],
    )
    names = [f"{kind}{i}" for kind in ("pos", "neg") for i in range(SLOTS)]
    totals = running_totals(kinds, ["chunk", "detector"], "score", names)
    won = [F.sum(F.col(f"pos{i}").cast("double") * (F.col(f"neg{i}_before") + F.col(f"neg{i}") / F.lit(2.0))) for i in range(SLOTS)]
    pairs = [F.max(f"pos{i}_all").cast("double") * F.max(f"neg{i}_all") for i in range(SLOTS)]
    aucs = totals.groupBy("chunk", "detector").agg(F.array(*[F.when(p > 0, w / p) for w, p in zip(won, pairs, strict=True)]).alias("_a"))
    each = aucs.select("detector", F.explode("_a").alias("AUC_ROC")).filter(F.col("AUC_ROC").isNotNull())
    tail = (1.0 - level) / 2.0
    return exact_percentiles(each, ["detector"], "AUC_ROC", {"auc_low": tail, "auc_high": 1.0 - tail})


def export_names(metrics: DataFrame) -> DataFrame:
    """Column names of the metrics file."""
    for ours, theirs in EXPORT_NAMES.items():
        metrics = metrics.withColumnRenamed(ours, theirs)
    return metrics
