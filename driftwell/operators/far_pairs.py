"""Sums of distances of rows to all rows of a large table, without meeting all pairs.

The right side's rows lie in the leaves of a binary tree, at most ``2 ** MAX_DEPTH`` whatever the data, cut by a sample of
them (the cuts never change a result). Each cell of the tree has a ball and, where the rank of its distances allows,
a stand-in of few weighted rows (see ``functions/far_sums.py``). The rows of a target leaf meet the stand-ins of the
largest cells that lie far enough off, and the rows of the other leaves one by one. Target leaves are met in units, so
that a right row is copied to the few units around it. Where that leaves more than ``WORTH`` of all pairs (wide
vectors, no structure) there is nothing to gain and the caller takes the grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.distances import distance_sums
from driftwell.functions.far_sums import PRECISION, Cell, Tree, joined_levels, leaf_cell, meetings
from driftwell.operators.pairs import Block, as_array, copies_of, empty_table, id_field, n_blocks, spread
from driftwell.session import cut_lineage

#: Pairs from which sums are looked for this way, and the widest vectors for which they are.
FAR_PAIRS, FAR_WIDTH = 1 << 34, 16
WORTH = 0.3
LEAF_ROWS, MAX_DEPTH = 1536, 12
#: Sampled rows of a leaf for the cuts.
SAMPLED = 24
#: Levels that one task joins; leaves and rows of a unit of targets.
JOINED_LEVELS = 4
UNIT_LEAVES, UNIT_ROWS = 32, 1 << 16
READ_ROWS = 1 << 14

CELLS = "level int, node int, centre array<double>, radius double, x array<double>, n array<double>"
_ARRAY = pa.list_(pa.float64())
_CELL_TYPES = [pa.int32(), pa.int32(), _ARRAY, pa.float64(), _ARRAY, _ARRAY]


def far_sums(left: DataFrame, right: DataFrame, *, n_left: int, n_right: int) -> DataFrame | None:
    """(row_id, total): for each left row (row_id, v) the sum of its distances to the right rows (row_id, v, n), each counted
    n times, and multiplied by its own n where it has one. None where the caller should meet all pairs."""
    if n_left * n_right < FAR_PAIRS:
        return None
    about = right.agg(
        F.max(F.size("v")).alias("width"),
        F.min(F.size("v")).alias("narrowest"),
        F.count_if(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))).alias("odd"),
    ).first()
    if not about["width"] or about["width"] > FAR_WIDTH or about["narrowest"] != about["width"] or about["odd"]:
        return None
    # a vector that many rows share is one row of a leaf
    right = right.groupBy("v").agg(F.sum("n").alias("n")).select(F.lit(0).alias("row_id"), "v", "n")
    depth = int(min(MAX_DEPTH, max(1, np.ceil(np.log2(n_right / LEAF_ROWS)))))
    sample = _sample(right, max(1, n_right // (SAMPLED << depth)))
    if len(sample) < 2:
        return None
    tree, tolerance = Tree.of(sample, depth), PRECISION * float(np.sqrt(2.0 * sample.var(axis=0).sum()))
    if not tolerance > 0.0:
        return None
    sources = cut_lineage(_placed(right, tree))
    targets = cut_lineage(_placed(left, tree))
    levels = _cells(sources, tree, tolerance)
    held = _counts(sources, depth)
    centres, radii, asking = _balls(targets, tree)
    far, near = meetings(levels, centres, radii)
    cells = [c for level in levels for c in level]
    kept = np.array([0 if c is None or c.x is None else len(c.x) for c in cells])
    met = sum(float(asking[t]) * float(held[near[t]].sum() + kept[far[t]].sum()) for t in np.flatnonzero(asking))
    if met > WORTH * n_left * n_right:
        return None
    return _totals(targets, sources, tree, cells, far, near, asking)


def _sample(rows: DataFrame, step: int) -> np.ndarray:
    picked = rows.select("v").filter(F.pmod(F.xxhash64("v"), F.lit(step)) == 0).toArrow()
    flat = as_array(picked.column("v")).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(picked.num_rows, -1) if picked.num_rows else np.zeros((0, 0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for start in range(0, batch.num_rows, READ_ROWS):
            yield Block.of(pa.Table.from_batches([batch.slice(start, READ_ROWS)]))


def _placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """The rows with the leaf they lie in."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield from block.table.append_column("leaf", pa.array(sent.value.leaves(block.x))).combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, leaf int")


def _counts(rows: DataFrame, depth: int) -> np.ndarray:
    out = np.zeros(2**depth, np.int64)
    for r in rows.groupBy("leaf").count().collect():
        out[r["leaf"]] = r["count"]
    return out


def _balls(targets: DataFrame, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre and radius of a ball around each leaf's targets, and their number; rows with a coordinate that is no number have no
    place and any sum of theirs is none. Extremes are kept per task."""
    n_leaves, width = 2**tree.depth, tree.axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((n_leaves, width), np.inf), np.full((n_leaves, width), -np.inf)
        for block in _blocks(batches):
            leaf, x = block.table.column("leaf").to_numpy(), block.x
            finite = np.isfinite(x).all(axis=1)
            np.minimum.at(low, leaf[finite], x[finite])
            np.maximum.at(high, leaf[finite], x[finite])
        seen = np.flatnonzero(low[:, 0] < np.inf)
        if len(seen):
            yield pa.RecordBatch.from_pydict(
                {
                    "leaf": np.repeat(seen, width).astype(np.int32),
                    "pos": np.tile(np.arange(width, dtype=np.int32), len(seen)),
                    "low": low[seen].ravel(),
                    "high": high[seen].ravel(),
                }
            )

    boxes = targets.mapInArrow(run, "leaf int, pos int, low double, high double")
    low, high = np.full((n_leaves, width), np.nan), np.full((n_leaves, width), np.nan)
    for r in boxes.groupBy("leaf", "pos").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r["leaf"], r["pos"]], high[r["leaf"], r["pos"]] = r["low"], r["high"]
    radii = np.sqrt((((high - low) / 2) ** 2).sum(axis=1))
    there = ~np.isnan(radii)
    return np.where(there[:, None], (low + high) / 2, 0.0), np.where(there, radii, -1.0), _counts(targets, tree.depth)


# ---- cells


def _cell_rows(levels: list[list[Cell | None]], first: list[int]) -> pa.Table:
    """Cells of some levels, whose first nodes are numbered ``first``, as rows."""
    rows = [
        (number, start + i, c.centre, c.radius, [] if c.x is None else c.x.ravel(), [] if c.n is None else c.n)
        for number, (level, start) in enumerate(zip(levels, first, strict=True))
        for i, c in enumerate(level)
        if c is not None
    ]
    columns = zip(*rows, strict=True) if rows else [[] for _ in _CELL_TYPES]
    names = ["level", "node", "centre", "radius", "x", "n"]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, _CELL_TYPES, strict=True)], names=names)


def _cells(sources: DataFrame, tree: Tree, tolerance: float) -> list[list[Cell | None]]:
    """All cells by level, the leaves first: lower levels are joined in the tasks of some leaves, the next ones in tasks over those."""
    lower = min(JOINED_LEVELS, tree.depth)
    width = 2**lower

    def leaves(key: tuple, table: pa.Table) -> pa.Table:
        start = key[0].as_py() * width
        block, leaf = Block.of(table), table.column("leaf").to_numpy()
        n, cells = copies_of(block), []
        for i in range(start, start + width):
            here = leaf == i
            cells.append(leaf_cell(block.x[here], n[here], tolerance) if here.any() else None)
        levels = [cells, *joined_levels(cells, tolerance, lower)]
        return _cell_rows(levels, [start >> k for k in range(lower + 1)])

    grouped = sources.withColumn("_g", F.shiftright("leaf", lower)).groupBy("_g")
    levels = _collected(grouped.applyInArrow(leaves, CELLS), tree, 0, lower)
    while tree.depth - (len(levels) - 1) > JOINED_LEVELS:
        levels += _joined(sources, tree, levels[-1], len(levels) - 1, tolerance)
    return levels + joined_levels(levels[-1], tolerance, tree.depth - (len(levels) - 1))


def _joined(sources: DataFrame, tree: Tree, cells: list[Cell | None], below: int, tolerance: float) -> list[list[Cell | None]]:
    spark = sources.sparkSession
    sent = spark.sparkContext.broadcast(cells)
    width = 2**JOINED_LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column("id").to_pylist():
                start = group * width
                levels = joined_levels(sent.value[start : start + width], tolerance, JOINED_LEVELS)
                yield from _cell_rows(levels, [start >> k for k in range(1, JOINED_LEVELS + 1)]).to_batches()

    groups = len(cells) // width
    return _collected(spark.range(0, groups, 1, groups).mapInArrow(run, CELLS), tree, below + 1, JOINED_LEVELS - 1)


def _collected(found: DataFrame, tree: Tree, below: int, levels: int) -> list[list[Cell | None]]:
    """The cells of levels ``below`` to ``below + levels``; their number and that of their rows is bounded."""
    out: list[list[Cell | None]] = [[None] * 2 ** (tree.depth - below - k) for k in range(levels + 1)]
    width = tree.axes.shape[1]
    for batch in found.toArrow().to_batches():
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            level, node, centre, radius, x, n = (c[i] for c in columns)
            n = n.values.to_numpy()
            cell = Cell(centre.values.to_numpy().copy(), radius.as_py(), None, None)
            if len(n):
                cell.x, cell.n = x.values.to_numpy().reshape(-1, width).copy(), n.copy()
            out[level.as_py()][node.as_py()] = cell
    return out


# ---- meeting


def _totals(
    targets: DataFrame,
    sources: DataFrame,
    tree: Tree,
    cells: list[Cell | None],
    far: list[np.ndarray],
    near: list[np.ndarray],
    asking: np.ndarray,
) -> DataFrame:
    spark = targets.sparkSession
    n_leaves = 2**tree.depth
    unit_leaves = int(min(UNIT_LEAVES, max(1, n_leaves // (8 * spark.sparkContext.defaultParallelism))))
    units = range(0, n_leaves, unit_leaves)
    parts = [(u, n_blocks(int(asking[s : s + unit_leaves].sum()), UNIT_ROWS)) for u, s in enumerate(units)]
    asked = [
        (int(leaf), u, parts[u][1]) for u, s in enumerate(units) for leaf in np.unique(np.concatenate(near[s : s + unit_leaves]))
    ]
    a = targets.withColumn("_u", F.floor(F.col("leaf") / unit_leaves).cast("int"))
    a = a.join(F.broadcast(spark.createDataFrame(parts, "_u int, parts int")), "_u")
    a = a.withColumn("_p", F.pmod(F.xxhash64("row_id", "v"), F.col("parts")).cast("int")).drop("parts")
    b = sources.join(F.broadcast(spark.createDataFrame(asked, "leaf int, _u int, parts int")), "leaf")
    b = b.withColumn("_p", spread(F.lit(0), F.col("parts") - 1)).drop("parts")
    sent = spark.sparkContext.broadcast((*_store(cells), far, near))
    weighted = "n" in targets.columns
    schema = f"{id_field(targets)}, total double"
    return a.groupBy("_u", "_p").cogroup(b.groupBy("_u", "_p")).applyInArrow(_meet(sent, weighted, schema), schema)


def _store(cells: list[Cell | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stand-ins of all cells one after another, their weights, and where each cell's begin."""
    held = [c for c in cells if c is not None and c.x is not None]
    sizes = [0 if c is None or c.x is None else len(c.x) for c in cells]
    return np.concatenate([c.x for c in held]), np.concatenate([c.n for c in held]), np.cumsum([0, *sizes])


def _meet(sent: Broadcast, weighted: bool, schema: str):
    empty = empty_table(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return empty
        stand_ins, weights, starts, far, near = sent.value
        x, leaf = Block.of(a), a.column("leaf").to_numpy()
        y, at = Block.of(b), b.column("leaf").to_numpy()
        n, rows, total = copies_of(y), np.argsort(at, kind="stable"), np.empty(a.num_rows)
        at = at[rows]
        for here in np.unique(leaf):
            own = np.flatnonzero(leaf == here)
            ours = [rows[slice(*np.searchsorted(at, [other, other + 1]))] for other in near[here]]
            met = np.concatenate(ours) if ours else np.zeros(0, np.int64)
            theirs = [np.arange(starts[c], starts[c + 1]) for c in far[here]]
            away = np.concatenate(theirs) if theirs else np.zeros(0, np.int64)
            near_total = distance_sums(x.x[own], y.x[met], n[met]) if len(met) else 0.0
            total[own] = near_total + (distance_sums(x.x[own], stand_ins[away], weights[away]) if len(away) else 0.0)
        total[~np.isfinite(x.x).all(axis=1)] = np.nan
        if weighted:
            total *= a.column("n").to_numpy()
        return pa.table({"row_id": x.ids, "total": total})

    return run
