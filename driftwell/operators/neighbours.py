"""Kullback-Leibler divergence from nearest-neighbour distances (Wang et al., 2009)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.distances import distances
from driftwell.operators.detectors import packed_weights, unit_weights, weight_columns, weight_keys
from driftwell.operators.pairs import (
    Block,
    PairPlan,
    as_array,
    dense_weights,
    hash_block,
    id_field,
    merged_rows,
    n_blocks,
    nearest_distances,
    nearest_rows,
)
from driftwell.session import cut_lineage

DISTANCE_FLOOR = 1e-12
#: Length of a row's list as a multiple of k, and rows whose lists one task walks at a time.
LISTED = 8
WALK_ROWS = 128


def resampled_neighbour_distances(
    pool: DataFrame, weights: DataFrame, k: int, *, share: bool | None = None
) -> DataFrame:
    """(keys..., row_id, kth_distance): distance to the k-th nearest row inside each
    resample, the row's own copies coming first.

    Copies count: it is the distance at which the weights, added up from near to far,
    reach k. Where every row sees the whole pool in one block, the block says so. Beyond
    that the pairs are met once, for a list of the ``LISTED * k`` nearest pool rows of
    each row whatever the number of resamples; each resample adds its weights along the
    list. A list that ends before k (a resample that leaves out most rows near by) is
    followed by all blocks, for that row and those resamples alone.
    """
    columns, n_columns = weight_columns(weights)
    packed = cut_lineage(pool.select("row_id", "v").join(packed_weights(weights, columns), "row_id"))
    plan = PairPlan(packed, packed, share=share)
    if plan.whole:
        kth = _walk_blocks(plan, k, n_columns)
    else:
        walked = cut_lineage(_walk_lists(packed, nearest_rows(packed, packed, LISTED * k, share=False), plan.n_right, k, n_columns))
        kth = walked.filter("kth_distance IS NOT NULL")
        early = walked.filter("kth_distance IS NULL")
        if not early.isEmpty():
            asked = early.groupBy("row_id").agg(F.collect_list("col").alias("cols"))
            left = packed.select("row_id", "v").join(asked, "row_id").withColumn("ws", F.transform("cols", lambda c: F.lit(1.0)))
            kth = kth.union(_walk_blocks(PairPlan(left, packed, share=False), k, n_columns))
    return kth.join(F.broadcast(columns), "col").drop("col")


def _walk_lists(packed: DataFrame, near: DataFrame, n_rows: int, k: int, n_columns: int) -> DataFrame:
    """(row_id, col, kth_distance) for each resample a row occurs in, null where its list ends before k.

    Tasks take some ``WALK_ROWS`` rows at a time, dealt by hash: their lists with the weights of the rows
    listed, and their own weights (without a distance)."""
    others = packed.select(F.col("row_id").alias("other"), "cols", "ws")
    entries = near.join(others, "other").select("row_id", "d", "cols", "ws")
    own = packed.select("row_id", F.lit(None).cast("double").alias("d"), "cols", "ws")
    dealt = hash_block(entries.union(own), "_walk", n_blocks(n_rows, WALK_ROWS))

    def walk(t: pa.Table) -> pa.Table:
        ids = as_array(t.column("row_id")).dictionary_encode()
        row, n = ids.indices.to_numpy(), len(ids.dictionary)
        w = dense_weights(t, n_columns)
        itself = t.column("d").is_null().to_numpy()
        present = np.zeros((n, n_columns), bool)
        present[row[itself]] = w[itself] > 0
        listed = np.flatnonzero(~itself)
        d = t.column("d").to_numpy()
        listed = listed[np.lexsort((d[listed], row[listed]))]
        place = np.arange(len(listed)) - np.searchsorted(row[listed], row[listed])
        width = place.max(initial=0) + 1
        far, copies = np.full((n, width), np.inf), np.zeros((n, width, n_columns))
        far[row[listed], place], copies[row[listed], place] = d[listed], w[listed]
        reached = np.cumsum(copies, axis=1) >= k
        kth = np.take_along_axis(far, reached.argmax(axis=1), axis=1)
        i, c = np.nonzero(present)
        return pa.table(
            {
                "row_id": ids.dictionary.take(pa.array(i)),
                "col": c.astype(np.int32),
                "kth_distance": pa.array(kth[i, c], mask=~reached[i, -1, c]),
            }
        )

    return dealt.groupBy("_walk").applyInArrow(walk, f"{id_field(packed)}, col int, kth_distance double")


def _walk_blocks(plan: PairPlan, k: int, n_columns: int) -> DataFrame:
    """(row_id, col, kth_distance) from all blocks. A block returns, per row and resample, just the
    nearest copies up to k; merging those of all blocks is exact."""
    whole = plan.whole

    def kernel(x: Block, y: Block) -> pa.Table | None:
        d = distances(x.x, y.x)
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, axis=1)
        present, copies = x.dense_weights(n_columns) > 0, y.dense_weights(n_columns)
        parts = [_near_copies(d, order, np.nonzero(present[:, c])[0], copies[:, c], k, whole) for c in range(n_columns)]
        rows = np.concatenate([p[0] for p in parts])
        if not len(rows):
            return None
        return pa.table(
            {
                "row_id": as_array(x.ids).take(pa.array(rows)),
                "col": np.repeat(np.arange(n_columns, dtype=np.int32), [len(p[0]) for p in parts]),
                "d": np.concatenate([p[1] for p in parts]),
                "n": np.concatenate([p[2] for p in parts]).astype(np.int64),
            }
        )

    near = plan.run(kernel, f"{id_field(plan.left)}, col int, d double, n bigint")
    if whole:
        return near.select("row_id", "col", F.col("d").alias("kth_distance"))
    upto = F.sum("n").over(Window.partitionBy("row_id", "col").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    return (
        near.withColumn("_upto", upto)
        .filter(F.col("_upto") >= k)
        .groupBy("row_id", "col")
        .agg(F.min("d").alias("kth_distance"))
    )


def _near_copies(
    d: np.ndarray, order: np.ndarray, rows: np.ndarray, copies: np.ndarray, k: int, only_kth: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (row, distance, copies) of the nearest copies of the given rows, up to k
    copies per row, or just the k-th one. Few neighbours are looked at first, all of
    them for the rows for which those do not suffice."""
    found = []
    width = min(8 * k, d.shape[1])
    while len(rows):
        w = copies[order[rows, :width]]
        before = np.cumsum(w, axis=1) - w
        done = before[:, -1] + w[:, -1] >= k
        if width == d.shape[1]:
            done[:] = True
        pick = (w > 0) & (before < k) & done[:, None]
        if only_kth:
            pick &= before + w >= k
        i, j = np.nonzero(pick)
        found.append((rows[i], d[rows[i], j], w[i, j]))
        rows, width = rows[~done], d.shape[1]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)
    return tuple(np.concatenate(part) for part in zip(*found))


def neighbour_kl_scores(
    reference: DataFrame,
    pool: DataFrame,
    weights: DataFrame | None = None,
    *,
    n_neighbors: int = 5,
    share: bool | None = None,
) -> DataFrame:
    """max(0, d * mean ln(rho / nu) + ln(m / (n - 1))) per resample."""
    weights = unit_weights(pool) if weights is None else weights
    keys = weight_keys(weights)
    size = reference.agg(F.count("*").alias("m"), F.max(F.size("v")).alias("d")).first()
    m, d = size["m"], size["d"]
    n_test = weights.groupBy(*keys).agg(F.sum("w").alias("n"))
    smallest = n_test.agg(F.min("n")).first()[0] or 0
    if m < n_neighbors or smallest < n_neighbors + 1:
        raise ValueError(f"{n_neighbors} neighbours need {n_neighbors} reference and {n_neighbors + 1} test rows")
    pool, weights = merged_rows(pool.select("row_id", "v"), weights)
    rho = nearest_distances(pool, reference, n_neighbors, share=share).withColumnRenamed("kth_distance", "rho")
    nu = resampled_neighbour_distances(pool, weights, n_neighbors + 1, share=share)
    ratio = F.log(F.greatest("rho", F.lit(DISTANCE_FLOOR))) - F.log(F.greatest("kth_distance", F.lit(DISTANCE_FLOOR)))
    return (
        nu.join(weights, [*keys, "row_id"])
        .join(rho, "row_id")
        .groupBy(*keys)
        .agg((F.sum(F.col("w") * ratio) / F.sum("w")).alias("_mean"), F.sum("w").alias("_n"))
        .select(
            *keys,
            F.greatest(F.lit(0.0), d * F.col("_mean") + F.log(F.lit(float(m)) / (F.col("_n") - 1))).alias("score"),
        )
    )
