"""Shared plumbing of the two-sample detectors.

Every detector takes a reference view (row_id, v), a pool view (row_id, v) and
resample weights (keys..., row_id, w), and returns (keys..., score), larger meaning
more drift. Comparing two plain tables is the case of one resample with weight 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID_KEYS = ["phase", "alpha", "run"]


def unit_weights(pool: DataFrame) -> DataFrame:
    """One resample that takes every pool row once."""
    return pool.select("row_id", F.lit(1).alias("w"), F.lit(0).alias("run"))


def weight_keys(weights: DataFrame) -> list[str]:
    return [c for c in weights.columns if c not in ("row_id", "w")]


def weight_columns(weights: DataFrame) -> tuple[DataFrame, int]:
    """Number the resamples 0..C-1: (keys..., col) and C, the size of the run grid."""
    keys = weight_keys(weights)
    spark = weights.sparkSession
    grid = weights.select(*keys).distinct().orderBy(*keys).collect()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in weights.select(*keys).schema)
    rows = [(*r, i) for i, r in enumerate(grid)]
    return spark.createDataFrame(rows, f"{schema}, col int"), len(rows)


def packed_weights(weights: DataFrame, columns: DataFrame) -> DataFrame:
    """(row_id, cols, ws): the resamples a row occurs in. A row has at most one entry
    per resample, so the arrays are bounded by the run grid."""
    numbered = weights.join(F.broadcast(columns), weight_keys(weights))
    return (
        numbered.groupBy("row_id")
        .agg(F.collect_list(F.struct("col", F.col("w").cast("double").alias("w"))).alias("e"))
        .select("row_id", F.col("e.col").alias("cols"), F.col("e.w").alias("ws"))
    )


def weighted_mean(values: DataFrame, weights: DataFrame, value: str, out: str) -> DataFrame:
    """(keys..., out): mean of a per-row value under every resample."""
    keys = weight_keys(weights)
    return (
        weights.join(values, "row_id")
        .groupBy(*keys)
        .agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(out))
    )
