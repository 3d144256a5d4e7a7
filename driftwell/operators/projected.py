"""Distance detector: how much farther from the reference the test rows lie than
the reference rows from each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators.detectors import unit_weights, weighted_mean
from driftwell.operators.pairs import mean_distances, mean_pair_distance, merged_rows
from driftwell.operators.views import pca_views


def mean_self_distance(reference: DataFrame) -> float:
    """Mean distance of all reference pairs, the zero distances to itself included."""
    return mean_pair_distance(reference)


def distance_scores(
    reference: DataFrame, pool: DataFrame, weights: DataFrame | None = None, *, n_components: int | None = 16
) -> DataFrame:
    """|mean d(reference, test) - mean d(reference, reference)| after projection on the
    reference's principal components (no projection when ``n_components`` is None)."""
    if n_components is not None:
        reference, pool = pca_views(reference, pool, n_components)
    weights = unit_weights(pool) if weights is None else weights
    within = mean_self_distance(reference)
    pool, weights = merged_rows(pool, weights)
    crossing = weighted_mean(mean_distances(pool, reference), weights, "mean_distance", "crossing")
    return crossing.withColumn("score", F.abs(F.col("crossing") - F.lit(within))).drop("crossing")
