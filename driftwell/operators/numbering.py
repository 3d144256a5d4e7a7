"""Dense row numbers, exact-fraction splits and samples without replacement.

Rows are ordered by the md5 of their key. The first hex digits of that md5 are
evenly filled buckets, whatever the data look like, so a number is the count of
the earlier buckets plus a rank inside one small bucket: no step sorts a whole
group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.hashing import hash_key

BUCKET_DIGITS = 4


def _bucketed(df: DataFrame, row_id: str, tag: str) -> DataFrame:
    keyed = df.withColumn("_hash", hash_key(tag, F.col(row_id)))
    return keyed.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))


def bucket_counts(df: DataFrame, row_id: str, groups: list[str] | None = None, *, tag: str = "rows") -> DataFrame:
    """(groups..., _bucket, _n): rows per hash bucket, at most 16^4 per group."""
    return _bucketed(df, row_id, tag).groupBy(*(groups or []), "_bucket").agg(F.count("*").alias("_n"))


def number_rows(
    df: DataFrame,
    row_id: str,
    groups: list[str] | None = None,
    *,
    tag: str = "rows",
    out: str = "rn",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add a dense 0-based number within each group; ``counts`` are the bucket counts, if
    the caller has them already."""
    groups = list(groups or [])
    bucket = [*groups, "_bucket"]
    ranked = _bucketed(df, row_id, tag).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*bucket).orderBy("_hash", row_id))
    )
    earlier = (
        Window.partitionBy(*(groups or [F.lit(0)]))
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = bucket_counts(df, row_id, groups, tag=tag) if counts is None else counts
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        ranked.join(offsets, bucket)
        .withColumn(out, (F.col("_offset") + F.col("_rank") - 1).cast("bigint"))
        .drop("_hash", "_bucket", "_rank", "_offset")
    )


def hash_cutoff(df: DataFrame, row_id: str, fraction: float, *, seed: int, tag: str) -> tuple[str, object] | None:
    """(md5, row id) of the last of the first floor(fraction * n) rows in hash order;
    None when there are none.

    Two narrow passes over the key column: bucket counts, then the rows of the one
    bucket in which that row lies.
    """
    keyed = df.select(row_id, hash_key(seed, tag, F.col(row_id)).alias("_hash"))
    keyed = keyed.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    whole = Window.partitionBy(F.lit(0))  # one row per bucket
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    crossing = (
        counts.withColumn("_upto", F.sum("_n").over(whole.orderBy("_bucket")))
        .withColumn("_k", F.floor(F.lit(float(fraction)) * F.sum("_n").over(whole)))
        .filter((F.col("_upto") >= F.col("_k")) & (F.col("_k") > F.col("_upto") - F.col("_n")))
        .first()
    )
    if crossing is None:
        return None
    inside = crossing["_k"] - (crossing["_upto"] - crossing["_n"])
    last = (
        keyed.filter(F.col("_bucket") == crossing["_bucket"])
        .withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", row_id)))
        .filter(F.col("_rank") == inside)
        .first()
    )
    return last["_hash"], last[row_id]


def split_by_fraction(
    df: DataFrame, row_id: str, fraction: float, *, seed: int, tag: str = "split"
) -> DataFrame:
    """Add boolean ``is_reference``: true for exactly floor(fraction * n) rows.

    Only a comparison with the cut-off runs over the wide rows, without a shuffle.
    """
    cutoff = hash_cutoff(df, row_id, fraction, seed=seed, tag=tag)
    if cutoff is None:
        return df.withColumn("is_reference", F.lit(False))
    last_hash, last_id = cutoff
    h = hash_key(seed, tag, F.col(row_id))
    inside = (h < last_hash) | ((h == last_hash) & (F.col(row_id) <= F.lit(last_id)))
    return df.withColumn("is_reference", inside)


def sample_rows(df: DataFrame, row_id: str, size: int, *, seed: int, tag: str) -> DataFrame:
    """min(n, size) rows without replacement: the smallest hashes (a top-k, no full sort)."""
    return (
        df.withColumn("_hash", hash_key(seed, tag, F.col(row_id)))
        .orderBy("_hash", row_id)
        .limit(size)
        .drop("_hash")
    )
