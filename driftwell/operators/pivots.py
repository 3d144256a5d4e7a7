"""Exact nearest rows through a metric index: pivots, cells around them, and the triangle inequality.

Both sides are dealt to the cell of their nearest pivot. Of each cell of the right side the smallest and largest
distance to every pivot is known, so a left row, which knows its own distances to the pivots, has a lower bound of its
distance to all rows of a cell. Left rows first meet the nearest cells that hold enough rows; the distance of their
last neighbour there is a bound, and in the second round a row meets only the cells it does not exclude. Cells and
pivots are at most ``PIVOTS`` whatever the data; a cell that holds much of the table is met in groups of ``GROUP_ROWS``
rows. Data without structure excludes little: where the second round would meet more than ``WORTH`` of all pairs the
caller takes the square grid instead, which is as exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.distances import distances
from driftwell.operators.pairs import (
    Block,
    id_field,
    list_kernel,
    list_schema,
    meet,
    n_blocks,
    own_columns,
    shortest,
    spread,
)
from driftwell.session import cut_lineage

PIVOTS = 256
GROUP_ROWS = 8192
WORTH = 0.5
#: Relative slack of an exclusion, far above the rounding of distances.
SLACK = 1e-9


@dataclass
class Cells:
    """The right side's index: pivots, rows of each cell, and the cell's range of distances to each pivot."""

    pivots: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def first(self, length: int) -> np.ndarray:
        """cells x cells: the cells that rows of a cell meet first, the nearest pivots with ``length`` rows in all."""
        order = np.argsort(distances(self.pivots, self.pivots), axis=1, kind="stable")
        held = self.rows[order]
        enough = np.cumsum(held, axis=1) - held < length
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, enough & (held > 0), axis=1)
        return out

    def lower_bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        """rows x cells: no row of the cell is nearer, by any of the pivots."""
        out = np.zeros((len(to_pivots), len(self.rows)))
        for p in range(len(self.pivots)):
            at = to_pivots[:, p, None]
            np.maximum(out, np.maximum(self.low[:, p] - at, at - self.high[:, p]), out=out)
        return out


def choose_pivots(rows: DataFrame, n_rows: int) -> np.ndarray:
    """Vectors of the rows with the smallest key hashes, about the root of the rows and at most ``PIVOTS``."""
    count = int(min(PIVOTS, max(1, round(n_rows**0.5))))
    picked = rows.orderBy(F.xxhash64("row_id"), "row_id").limit(count).select("v").collect()
    return np.unique(np.array([r["v"] for r in picked], dtype=np.float64), axis=0)


def _with_cells(rows: DataFrame, schema: str, columns: Callable[[Block, np.ndarray], dict], pivots: np.ndarray) -> DataFrame:
    """The rows with columns computed of their distances to the pivots."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP_ROWS):
                part = pa.Table.from_batches([batch.slice(start, GROUP_ROWS)])
                block = Block.of(part)
                for name, values in columns(block, distances(block.x, sent.value)).items():
                    part = part.append_column(name, values)
                yield from part.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def _ranges(cells: DataFrame, pivots: np.ndarray) -> Cells:
    """Range of the distances of each cell to each pivot: extremes are kept per task, cells x pivots numbers each."""
    sent = cells.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(sent.value)
        low, high, rows = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.zeros(n, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP_ROWS):
                part = pa.Table.from_batches([batch.slice(start, GROUP_ROWS)])
                cell, d = part.column("cell").to_numpy(), distances(Block.of(part).x, sent.value)
                order = np.argsort(cell, kind="stable")
                cell, d = cell[order], d[order]
                at = np.flatnonzero(np.diff(cell, prepend=-1))
                c = cell[at]
                low[c] = np.minimum(low[c], np.minimum.reduceat(d, at, axis=0))
                high[c] = np.maximum(high[c], np.maximum.reduceat(d, at, axis=0))
                rows[c] += np.diff(np.append(at, len(cell)))
        c = np.flatnonzero(rows)
        if len(c):
            i = np.repeat(c, n).astype(np.int32)
            p = np.tile(np.arange(n, dtype=np.int32), len(c))
            yield pa.RecordBatch.from_pydict(
                {"cell": i, "pivot": p, "low": low[c].ravel(), "high": high[c].ravel(), "n": np.repeat(rows[c], n)}
            )

    found = cells.mapInArrow(run, "cell int, pivot int, low double, high double, n long")
    total = found.groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    n = len(pivots)
    low, high, rows = np.zeros((n, n)), np.zeros((n, n)), np.zeros(n, np.int64)
    for r in total.collect():
        low[r["cell"], r["pivot"]], high[r["cell"], r["pivot"]], rows[r["cell"]] = r["low"], r["high"], r["n"]
    return Cells(pivots, rows, low, high)


def _lists(flags: np.ndarray) -> pa.Array:
    """Arrays of the columns that are set in each row."""
    offsets = np.concatenate([[0], np.cumsum(flags.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(flags)[1].astype(np.int32)))


def _asked(left: DataFrame, n_cells: int) -> np.ndarray:
    """How many left rows ask for each cell."""
    out = np.zeros(n_cells, np.int64)
    for r in left.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():
        out[r["cell"]] = r["count"]
    return out


def _met(left: DataFrame, right: DataFrame, asked: np.ndarray, held: np.ndarray, length: int) -> DataFrame:
    """Lists of the left rows (row_id, v, cells) over the right rows (row_id, v, cell) of the cells they ask for."""
    sizes = [
        (c, n_blocks(int(asked[c]), GROUP_ROWS), n_blocks(int(held[c]), GROUP_ROWS)) for c in np.flatnonzero(asked).tolist()
    ]
    groups = F.broadcast(left.sparkSession.createDataFrame(sizes, "cell int, lefts int, rights int"))
    a = left.select("row_id", "v", F.explode("cells").alias("cell")).join(groups, "cell")
    a = a.withColumn("_i", F.pmod(F.xxhash64("row_id"), F.col("lefts")).cast("int")).withColumn("_j", spread(0, F.col("rights") - 1))
    b = own_columns(right).join(groups, "cell")
    b = b.withColumn("_j", F.pmod(F.xxhash64("row_id"), F.col("rights")).cast("int")).withColumn("_i", spread(0, F.col("lefts") - 1))
    columns = ["row_id", "v", "cell", "_i", "_j"]
    return meet(a.select(*columns), b.select(*columns), ["cell", "_i", "_j"], list_kernel(length), list_schema(left, right), by_group=True)


@dataclass
class Found:
    """Lists (row_id, other, d) and the share of all pairs that were met for them; no lists where the share is too large."""

    near: DataFrame | None
    share: float


def indexed_nearest_rows(left: DataFrame, right: DataFrame, length: int, *, worth: float = WORTH) -> Found:
    """As ``nearest_rows``: the ``length`` nearest right rows of each left row, all if there are fewer.

    Equal rows, ties and a single cell are fine: a cell is only excluded if its bound lies above the last distance.
    """
    left, right = left.select("row_id", "v"), right.select("row_id", "v")
    n_left, n_right = left.count(), right.count()
    if not n_left or not n_right:
        return Found(left.sparkSession.createDataFrame([], list_schema(left, right)), 0.0)
    pivots = choose_pivots(right, n_right)
    vector = left.schema["v"].dataType.simpleString()

    def nearest_pivot(_: Block, d: np.ndarray) -> dict:
        return {"cell": pa.array(d.argmin(axis=1).astype(np.int32))}

    field = f"row_id {right.schema['row_id'].dataType.simpleString()}, v {right.schema['v'].dataType.simpleString()}"
    cells = cut_lineage(_with_cells(right, f"{field}, cell int", nearest_pivot, pivots))
    index = _ranges(cells, pivots)
    first = index.first(length)

    def first_cells(_: Block, d: np.ndarray) -> dict:
        return {"cells": _lists(first[d.argmin(axis=1)])}

    asking = f"{id_field(left)}, v {vector}, cells array<int>"
    start = cut_lineage(_with_cells(left, asking, first_cells, pivots))
    asked = _asked(start, len(pivots))
    share = float(asked @ index.rows) / (n_left * n_right)
    if share > worth:
        return Found(None, share)
    near = cut_lineage(shortest(_met(start, cells, asked, index.rows, length), length))
    bound = near.groupBy("row_id").agg(F.when(F.count("*") >= length, F.max("d")).alias("bound"))

    def open_cells(block: Block, d: np.ndarray) -> dict:
        limit = block.table.column("bound").to_numpy()
        limit = np.where(np.isnan(limit), np.inf, limit)
        slack = SLACK * (1.0 + d.max(axis=1))
        reach = index.lower_bounds(d) <= (limit * (1.0 + SLACK) + slack)[:, None]
        return {"cells": _lists(reach & (index.rows > 0) & ~first[d.argmin(axis=1)])}

    bounded = left.join(bound, "row_id", "left").select("row_id", "v", "bound")
    again = cut_lineage(_with_cells(bounded, f"{id_field(left)}, v {vector}, bound double, cells array<int>", open_cells, pivots))
    more = _asked(again, len(pivots))
    share += float(more @ index.rows) / (n_left * n_right)
    if share > worth:
        return Found(None, share)
    if more.any():
        near = shortest(near.union(_met(again.filter(F.size("cells") > 0), cells, more, index.rows, length)), length)
    return Found(near, share)
