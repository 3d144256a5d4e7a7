"""Work over all pairs of two row sets, block against block.

A pair never becomes a row. Rows carry their vector to a block; a task holds one
block of each side as two matrices and returns per-row or per-block results. A
side within ``SHARED_ROWS`` rows and ``SHARED_BYTES`` bytes, both counted first, is
sent to the executors once and the other side streams past it without a shuffle.
Beyond that both sides are cut into hash groups that meet on an equi-key (left group,
right group), a square grid: a side of B blocks of ``BLOCK_ROWS`` rows makes about the
root of B groups, so a row is copied that often and not once per block, and a task walks
its two groups block by block. Pairs of a row set with itself take the triangle of
that grid. Group sizes depend only on how evenly the row keys hash, so no value, source
or class can make one large.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from driftwell.functions.distances import distance_sums, nearest
from driftwell.session import cut_lineage

SHARED_ROWS = 4096
SHARED_BYTES = 64 << 20
BLOCK_ROWS = 2048
STREAM_ROWS = 1024
INDEX_BLOCKS = 16
#: Rows, and rows for each different vector, from which equal vectors are looked for and meet as one.
DIFFERENT_ROWS, COPIES = 16 * BLOCK_ROWS, 2

T = TypeVar("T")


@dataclass
class Block:
    """Rows of one side: keys, vectors and sparse resample weights."""

    ids: pa.ChunkedArray | pa.Array
    x: np.ndarray
    table: pa.Table

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        flat = as_array(table.column("v")).flatten().to_numpy(zero_copy_only=False)
        x = np.asarray(flat, dtype=np.float64)
        n = table.num_rows
        return cls(table.column("row_id"), x.reshape(n, x.size // n if n else 0), table)

    def dense_weights(self, n_columns: int) -> np.ndarray:
        return dense_weights(self.table, n_columns)


def dense_weights(table: pa.Table, n_columns: int) -> np.ndarray:
    """rows x n_columns matrix from the packed arrays ``cols`` and ``ws``."""
    out = np.zeros((table.num_rows, n_columns))
    cols, ws = as_array(table.column("cols")), as_array(table.column("ws"))
    counts = np.asarray(cols.value_lengths(), dtype=np.int64)
    rows = np.repeat(np.arange(len(counts)), counts)
    out[rows, np.asarray(cols.flatten())] = np.asarray(ws.flatten())
    return out


def as_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


Kernel = Callable[[Block, Block], "pa.Table | None"]
SelfKernel = Callable[[Block, Block, int], "pa.Table | None"]


def grid_groups(n_blocks: int, busy: int) -> int:
    """Groups of a side: the root of its blocks, more only while that keeps ``busy`` tasks at work."""
    return min(n_blocks, max(math.isqrt(n_blocks - 1) + 1, math.isqrt(max(busy, 1) - 1) + 1))


def n_blocks(n_rows: int, block_rows: int) -> int:
    return max(1, -(-n_rows // block_rows))


def pieces(table: pa.Table, block_rows: int) -> Iterator[pa.Table]:
    """A task's group in blocks of at most ``block_rows`` rows."""
    for start in range(0, table.num_rows, block_rows):
        yield table.slice(start, block_rows)


class PairPlan:
    """How two sides meet: ``whole`` tells that each left row sees every right row in
    one block, so that a kernel may return finished rows."""

    def __init__(self, left: DataFrame, right: DataFrame, *, share: bool | None = None, block_rows: int = BLOCK_ROWS):
        self.left, self.right, self.block_rows = left, own_columns(right), block_rows
        self.n_right = right.count()
        first = right.select(F.size("v")).head()
        n_bytes = 8 * self.n_right * (first[0] if first else 0)
        if "ws" in right.columns:
            n_bytes += 12 * (right.agg(F.sum(F.size("ws"))).first()[0] or 0)
        small = self.n_right <= SHARED_ROWS and n_bytes <= SHARED_BYTES
        self.share = small if share is None else share
        self.right_blocks = n_blocks(self.n_right, block_rows)
        self.whole = self.share or self.right_blocks == 1

    def run(self, kernel: Kernel, schema: str, *, by_group: bool = False) -> DataFrame:
        """Apply ``kernel`` to blocks that together cover every pair once; with ``by_group`` a left block
        meets all right rows of its task as one block, for kernels that walk it in parts themselves."""
        return self._shared(kernel, schema) if self.share else self._tiled(kernel, schema, by_group)

    def _shared(self, kernel: Kernel, schema: str) -> DataFrame:
        small = self.left.sparkSession.sparkContext.broadcast(self.right.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block.of(small.value)
            for batch in batches:
                for start in range(0, batch.num_rows, STREAM_ROWS):
                    part = pa.Table.from_batches([batch.slice(start, STREAM_ROWS)])
                    result = kernel(Block.of(part), block)
                    if result is not None:
                        yield from result.combine_chunks().to_batches()

        return self.left.mapInArrow(run, schema)

    def _tiled(self, kernel: Kernel, schema: str, by_group: bool) -> DataFrame:
        busy, block_rows = self.left.sparkSession.sparkContext.defaultParallelism, self.block_rows
        left_groups = grid_groups(n_blocks(self.left.count(), block_rows), busy)
        right_groups = grid_groups(self.right_blocks, busy)
        a = hash_block(self.left, "_i", left_groups).withColumn("_j", spread(0, right_groups - 1))
        b = hash_block(self.right, "_j", right_groups).withColumn("_i", spread(0, left_groups - 1))
        return meet(a, b, ["_i", "_j"], kernel, schema, block_rows, by_group=by_group)


def meet(
    left: DataFrame, right: DataFrame, on: list[str], kernel: Kernel, schema: str, block_rows: int = BLOCK_ROWS, *, by_group: bool = False
) -> DataFrame:
    """Apply ``kernel`` to the blocks of both sides that share a key."""
    empty = empty_table(schema)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        others = [Block.of(part) for part in pieces(y, max(y.num_rows, 1) if by_group else block_rows)]
        out = []
        for part in pieces(x, block_rows) if others else ():
            block = Block.of(part)
            out += [r for r in (kernel(block, other) for other in others) if r is not None]
        return pa.concat_tables(out) if out else empty

    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, schema)


def triangle(rows: DataFrame, n_groups: int) -> tuple[DataFrame, DataFrame]:
    """Two sides that meet on (_i, _j), _i <= _j, over the groups of one row set. A group meets
    itself on the left side alone, so the right side is empty where _i = _j."""
    grouped = hash_block(rows, "_g", n_groups)
    left = grouped.withColumn("_i", F.col("_g")).withColumn("_j", spread(F.col("_g"), n_groups - 1)).drop("_g")
    later = own_columns(grouped).filter("_g > 0")
    return left, later.withColumn("_j", F.col("_g")).withColumn("_i", spread(0, F.col("_g") - 1)).drop("_g")


def triangle_groups(blocks: int, busy: int) -> int:
    """As ``grid_groups``; g groups make g (g + 1) / 2 tasks."""
    return grid_groups(blocks, 2 * busy)


def block_pairs(left: list[T], right: list[T]) -> Iterator[tuple[T, T, int]]:
    """Pairs of a task's blocks and how often each stands for its pairs of rows: twice unless a
    block meets itself; without a right side the blocks of the left one meet each other."""
    if right:
        yield from ((x, y, 2) for x in left for y in right)
        return
    for i, x in enumerate(left):
        yield x, x, 1
        yield from ((x, y, 2) for y in left[i + 1 :])


def self_pairs(rows: DataFrame, n_rows: int, kernel: SelfKernel, schema: str, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Apply ``kernel`` (block, block, times) to blocks of one row set; each unordered pair of
    different blocks meets once and counts twice."""
    groups = triangle_groups(n_blocks(n_rows, block_rows), rows.sparkSession.sparkContext.defaultParallelism)
    left, right = triangle(rows, groups)
    empty = empty_table(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = ([Block.of(part) for part in pieces(t, block_rows)] for t in (a, b))
        # a group without rows has nothing to meet, on either side
        met = block_pairs(x, y) if x and (y or diagonal(a)) else ()
        out = [r for r in (kernel(*pair) for pair in met) if r is not None]
        return pa.concat_tables(out) if out else empty

    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(run, schema)


def diagonal(table: pa.Table) -> bool:
    return table.column("_i")[0].as_py() == table.column("_j")[0].as_py()


def own_columns(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that both sides may stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def hash_block(df: DataFrame, out: str, n_blocks: int) -> DataFrame:
    """Assign rows to evenly filled blocks by the hash of their key."""
    return df.withColumn(out, F.pmod(F.xxhash64("row_id"), F.lit(n_blocks)).cast("int"))


def spread(first: int | Column, last: int | Column) -> Column:
    """One copy of the row for each block number of a range."""
    first, last = (b if isinstance(b, Column) else F.lit(b) for b in (first, last))
    return F.explode(F.sequence(first.cast("int"), last.cast("int")))


def empty_table(schema: str) -> pa.Table:
    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()


def id_field(df: DataFrame) -> str:
    return f"row_id {df.schema['row_id'].dataType.simpleString()}"


# ---- equal vectors


def different_vectors(rows: DataFrame) -> DataFrame | None:
    """(row_id, v, n): each different vector of ``rows`` (row_id, v) once, under a number of its own, with the rows that
    have it; None where few rows are equal or there are few rows, so that it is not worth the shuffle."""
    size = rows.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("v")).alias("different")).first()
    if size["n"] < DIFFERENT_ROWS or size["n"] < COPIES * size["different"]:
        return None
    counted = rows.groupBy("v").agg(F.count("*").alias("n"))
    return cut_lineage(counted.select(F.monotonically_increasing_id().alias("row_id"), "v", "n"))


def members(rows: DataFrame, different: DataFrame) -> DataFrame:
    """(row_id, of): the number of each row's vector in ``different``."""
    named = different.select(F.col("row_id").alias("of"), F.col("v").alias("_v"))
    return rows.select("row_id", "v").join(named, F.col("v").eqNullSafe(F.col("_v"))).select("row_id", "of")


def of_members(rows: DataFrame, different: DataFrame, found: DataFrame) -> DataFrame:
    """What was ``found`` (row_id, ...) of the different vectors, for each row that has one."""
    return members(rows, different).join(found.withColumnRenamed("row_id", "of"), "of").drop("of")


def merged_rows(rows: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, v) and resample weights (keys..., row_id, w) with equal vectors as one row that has their weights in
    all; as they are where that is not worth it."""
    different = different_vectors(rows)
    if different is None:
        return rows, weights
    keys = [c for c in weights.columns if c not in ("row_id", "w")]
    merged = weights.join(members(rows, different), "row_id").groupBy(*keys, F.col("of").alias("row_id")).agg(F.sum("w").alias("w"))
    return different.select("row_id", "v"), cut_lineage(merged)


def with_copies(rows: DataFrame) -> DataFrame:
    """(row_id, v, n): the different vectors, or each row as one of its own."""
    different = different_vectors(rows)
    return _once(rows) if different is None else different


def _once(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "v", F.lit(1).cast("bigint").alias("n"))


def copies_of(block: Block) -> np.ndarray:
    return block.table.column("n").to_numpy().astype(np.float64)


# ---- distances of rows to rows


def mean_distances(left: DataFrame, right: DataFrame, *, share: bool | None = None) -> DataFrame:
    """(row_id, mean_distance): mean Euclidean distance of each left row to all right rows. Equal vectors meet once, and
    where there are many pairs cells of rows far away count as a few (see ``far_pairs``)."""
    same = left is right
    left, right = left.select("row_id", "v"), right.select("row_id", "v")
    n_right, different = right.count(), different_vectors(left)
    copies = with_copies(right) if not same else _once(right) if different is None else different
    asking = left if different is None else different.select("row_id", "v")
    plan = PairPlan(asking, copies, share=share)

    def kernel(x: Block, y: Block) -> pa.Table:
        return pa.table({"row_id": x.ids, "total": distance_sums(x.x, y.x, copies_of(y))})

    sums = None if plan.whole else _far_sums(asking, copies, asking.count(), plan.n_right)
    if sums is None:
        sums = plan.run(kernel, f"{id_field(plan.left)}, total double", by_group=True)
    if not plan.whole:
        sums = sums.groupBy("row_id").agg(F.sum("total").alias("total"))
    if different is not None:
        sums = of_members(left, different, sums)
    return sums.select("row_id", (F.col("total") / F.lit(float(n_right))).alias("mean_distance"))


def mean_pair_distance(rows: DataFrame) -> float | None:
    """Mean distance of all pairs of ``rows``, the zero distances to themselves included; a pair meets once."""
    n, copies = rows.count(), with_copies(rows.select("row_id", "v"))
    n_copies = copies.count()

    def kernel(x: Block, y: Block, times: int) -> pa.Table:
        return pa.table({"total": [float(times * (copies_of(x) @ distance_sums(x.x, y.x, copies_of(y))))]})

    sums = _far_sums(copies, copies, n_copies, n_copies)
    if sums is None:
        sums = self_pairs(copies, n_copies, kernel, "total double")
    total = sums.agg(F.sum("total")).first()[0]
    return total / n**2 if n else None


def _far_sums(left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> DataFrame | None:
    from driftwell.operators.far_pairs import far_sums

    return far_sums(left, right, n_left=n_left, n_right=n_right)


def list_kernel(length: int) -> Kernel:
    """Kernel for (row_id, other, d): the ``length`` nearest right rows of each left row."""

    def kernel(x: Block, y: Block) -> pa.Table | None:
        if not len(x.x) or not len(y.x):
            return None
        at, d = nearest(x.x, y.x, length)
        rows = np.repeat(np.arange(len(d)), d.shape[1])
        ids, others = as_array(x.ids).take(pa.array(rows)), as_array(y.ids).take(pa.array(at.ravel()))
        return pa.table({"row_id": ids, "other": others, "d": d.ravel()})

    return kernel


def list_schema(left: DataFrame, right: DataFrame) -> str:
    return f"{id_field(left)}, other {right.schema['row_id'].dataType.simpleString()}, d double"


def shortest(near: DataFrame, length: int) -> DataFrame:
    """The ``length`` nearest entries of each row; a row has at most that many per task it took part in."""
    listed = near.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("d", "other"))).alias("_e"))
    return listed.select("row_id", F.inline(F.slice("_e", 1, length))).select("row_id", "other", "d")


def nearest_rows(
    left: DataFrame, right: DataFrame, length: int, *, share: bool | None = None, index: bool | None = None
) -> DataFrame:
    """(row_id, other, d): the ``length`` nearest right rows of each left row (all, if fewer).
    Which of several rows at the last distance are listed is left open.

    ``index``: exclude pairs by pivots first; by default from ``INDEX_BLOCKS`` blocks of right rows on.
    """
    left, right = left.select("row_id", "v"), right.select("row_id", "v")
    plan = PairPlan(left, right, share=share)
    if not plan.whole and plan.right_blocks >= INDEX_BLOCKS if index is None else index:
        from driftwell.operators.pivots import indexed_nearest_rows

        found = indexed_nearest_rows(left, right, length)
        if found.near is not None:
            return found.near
    near = plan.run(list_kernel(length), list_schema(left, right), by_group=True)
    return near if plan.whole else shortest(near, length)


def nearest_distances(
    left: DataFrame, right: DataFrame, k: int, *, share: bool | None = None, index: bool | None = None
) -> DataFrame:
    """(row_id, kth_distance): distance of each left row to its k-th nearest right row.

    A block returns its k smallest distances per row; the k-th of their union is exact. ``index`` as in ``nearest_rows``.
    """
    same = left is right
    left, right = left.select("row_id", "v"), right.select("row_id", "v")
    different = different_vectors(left)
    asking = left if different is None else different.select("row_id", "v")
    merged = different if same else different_vectors(right)
    plural, copies = merged is not None, _once(right) if merged is None else merged
    plan = PairPlan(asking, copies, share=share)
    whole = plan.whole
    if not whole and plan.right_blocks >= INDEX_BLOCKS if index is None else index:
        near = nearest_rows(asking, copies, k, share=share, index=index)
        if plural:  # then the numbers of the right rows are our own, so none repeats
            found = _kth(near.join(copies.select(F.col("row_id").alias("other"), "n"), "other"), k)
        else:
            found = near.groupBy("row_id").agg(F.max("d").alias("kth_distance"))
    else:

        def kernel(x: Block, y: Block) -> pa.Table:
            at, d = nearest(x.x, y.x, k)
            n = copies_of(y).astype(np.int64)[at]
            if whole:
                last = np.minimum((np.cumsum(n, axis=1) < k).sum(axis=1), d.shape[1] - 1)
                return pa.table({"row_id": x.ids, "d": np.take_along_axis(d, last[:, None], 1)[:, 0], "n": np.ones(len(d), np.int64)})
            ids = as_array(x.ids).take(pa.array(np.repeat(np.arange(len(d)), d.shape[1])))
            return pa.table({"row_id": ids, "d": d.ravel(), "n": n.ravel()})

        near = plan.run(kernel, f"{id_field(asking)}, d double, n bigint", by_group=True)
        found = near.select("row_id", F.col("d").alias("kth_distance")) if whole else _kth(near, k)
    return found if different is None else of_members(left, different, found)


def _kth(near: DataFrame, k: int) -> DataFrame:
    """(row_id, kth_distance) from entries (row_id, d, n): where the copies reach k, else the farthest entry."""
    before = F.sum("n").over(Window.partitionBy("row_id").orderBy("d").rowsBetween(Window.unboundedPreceding, -1))
    ranked = near.withColumn("_before", F.coalesce(before, F.lit(0)))
    return ranked.filter(F.col("_before") < k).groupBy("row_id").agg(F.max("d").alias("kth_distance"))
