"""Running totals and exact percentiles over sorted values, without sorting a group in one task.

Equal values are added up first. What is left is cut into value buckets at points that a
quantile sketch of it gives; totals of earlier buckets are added to running totals inside
each bucket. A bucket of a group holds about one part in ``BUCKETS`` of all rows at most,
however its values lie, so a group that holds most of the table is spread over many small
windows. The cuts decide only where the work is done, never a result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.session import cut_lineage

#: Buckets, and the sketch's accuracy: the rank of a cut is off by one row in so many.
BUCKETS, ACCURACY = 1024, 8192
INFINITY = float("inf")


def bucketed(values: DataFrame, value: str) -> DataFrame:
    """``values`` with an integer ``_bucket`` that never decreases when the value grows; NaN sorts last, as in Spark.

    ``values`` is read twice: once by the quantile sketch, whose cuts (at most ``BUCKETS`` - 1 numbers) are collected.
    """
    number = F.col(value).cast("double")
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = values.filter(~F.isnan(number)).agg(F.percentile_approx(number, shares, ACCURACY)).first()[0] or []
    splits = sorted({c for c in cuts if abs(c) < INFINITY}) or [0.0]
    place = Bucketizer(splits=[-INFINITY, *splits, INFINITY], inputCol="_number", outputCol="_bucket", handleInvalid="keep")
    return place.transform(values.withColumn("_number", number)).drop("_number").withColumn("_bucket", F.col("_bucket").cast("int"))


def running_totals(
    df: DataFrame, groups: list[str], value: str, sums: list[str], *, following: bool = False
) -> DataFrame:
    """One row per (groups, value) with, for every column s of ``sums``, its total
    ``s``, the total ``s_before`` over smaller values and the group's ``s_all``; with
    ``following`` also the next larger value of the group as ``following``."""
    summed = df.groupBy(*groups, value).agg(*[F.expr(f"sum({s}) AS {s}") for s in sums])
    cut = bucketed(cut_lineage(summed), value)  # what leads to ``df`` runs once
    keys = [*groups, "_bucket"]
    # the window, the bucket sums and the join share one partitioning by bucket
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    in_bucket = cut.select(
        "*",
        *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_in_{s}") for s in sums],
        *([F.lead(value).over(Window.partitionBy(*keys).orderBy(value)).alias("_next")] if following else []),
    )
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        in_bucket.groupBy(*keys)
        .agg(*[F.expr(f"sum({s}) AS _{s}") for s in sums], F.min(value).alias("_first"))
        .select(
            *keys,
            *([F.lead("_first").over(whole.orderBy("_bucket")).alias("_next_first")] if following else []),
            *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums],
            *[F.sum(f"_{s}").over(whole).alias(f"{s}_all") for s in sums],
        )
    )
    return in_bucket.join(offsets, keys).select(
        *groups,
        value,
        *sums,
        *[F.expr(f"_in_{s} + _off_{s} AS {s}_before") for s in sums],
        *[f"{s}_all" for s in sums],
        *([F.coalesce("_next", "_next_first").alias("following")] if following else []),
    )


def exact_percentiles(
    df: DataFrame, groups: list[str], value: str, probs: dict[str, float], *, weight: str | None = None
) -> DataFrame:
    """Percentiles with linear interpolation between order statistics, one named
    column per entry of ``probs``; nulls and NaN are left out."""
    counted = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *groups, F.col(value).cast("double").alias("_x"), (F.col(weight) if weight else F.lit(1)).alias("_n")
    )
    totals = running_totals(counted, groups, "_x", ["_n"])
    upto = F.col("_n_before") + F.col("_n")
    picks, result = [], []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("_n_all") - 1)
        low, high = f"_lo_{name}", f"_hi_{name}"
        picks += [
            F.min(F.when(upto > F.floor(position), F.col("_x"))).alias(low),
            F.min(F.when(upto > F.ceil(position), F.col("_x"))).alias(high),
            F.max(position - F.floor(position)).alias(f"_part_{name}"),
        ]
        result.append((F.col(low) + (F.col(high) - F.col(low)) * F.col(f"_part_{name}")).alias(name))
    return totals.groupBy(*groups).agg(*picks).select(*groups, *result)
