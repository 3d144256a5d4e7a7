"""Kernel two-sample tests: maximum mean discrepancy (Gretton et al., 2012) and
least-squares density difference (Sugiyama et al., 2013).

The score is 1 - p, p being the share of random relabellings of reference and test
rows whose statistic reaches the observed one. A relabelling is just another integer
weight vector over the same rows, so each block of kernel values is made once and
multiplied with all weight vectors of a chunk of resamples. Relabellings are never
stored: a row's side follows from its hash and the relabelling's cut, a number that is
found beforehand, so each task draws them for its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from driftwell.functions.distances import squared_distances
from driftwell.functions.hashing import hash_key, hash_text
from driftwell.operators.detectors import packed_weights, unit_weights, weight_columns, weight_keys
from driftwell.operators.numbering import sample_rows
from driftwell.operators.pairs import (
    Block,
    as_array,
    block_pairs,
    diagonal,
    empty_table,
    n_blocks,
    pieces,
    self_pairs,
    spread,
    triangle,
    triangle_groups,
)
from driftwell.session import cut_lineage

KERNEL_BLOCK_ROWS = 1024
CHUNK_COLUMNS = 2048
LABEL_DIGITS = 3
HISTOGRAM_BINS = 2048
FEW_PAIRS = 200_000
MAX_CENTRES = 200


# ---- bandwidth


def median_squared_distance(reference: DataFrame) -> float:
    """Exact median of the squared distances of all distinct row pairs.

    Blocks return counts of distances per bin; the bin with the median is cut into
    bins again until few distances are left, and only those are returned.
    """
    rows = reference.select("row_id", "v")
    n = rows.count()
    if n < 2:
        raise ValueError("a bandwidth needs two reference rows")
    # every unordered pair counts twice and n zero self-distances come first
    pairs = n * (n - 1)
    ranks = [n + pairs // 2 - 1, n + pairs // 2]

    def largest(x: Block, y: Block, times: int) -> pa.Table:
        return pa.table({"top": [float(squared_distances(x.x, y.x).max())]})

    low, high = 0.0, self_pairs(rows, n, largest, "top double").agg(F.max("top")).first()[0]
    below, inside = 0, n * n
    while inside > FEW_PAIRS and high > low:
        edges = np.linspace(low, high, HISTOGRAM_BINS + 1)

        def count(x: Block, y: Block, times: int, edges: np.ndarray = edges) -> pa.Table:
            counts, _ = np.histogram(squared_distances(x.x, y.x), edges)
            kept = np.nonzero(counts)[0]
            return pa.table({"bin": kept.astype(np.int32), "n": times * counts[kept].astype(np.int64)})

        counts = np.zeros(HISTOGRAM_BINS, dtype=np.int64)
        for r in self_pairs(rows, n, count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
            counts[r["bin"]] = r["n"]
        upto = below + np.cumsum(counts)
        first, last = (int(np.searchsorted(upto, r, side="right")) for r in ranks)
        narrowed = (float(edges[first]), float(edges[last + 1]))
        below += int(counts[:first].sum())
        inside = int(counts[first : last + 1].sum())
        if narrowed == (low, high):
            break
        low, high = narrowed
        if np.nextafter(low, high) >= high:
            break

    def tally(x: Block, y: Block, times: int) -> pa.Table:
        d2 = squared_distances(x.x, y.x).ravel()
        values, n_equal = np.unique(d2[(d2 >= low) & (d2 <= high)], return_counts=True)
        return pa.table({"d2": values, "n": times * n_equal.astype(np.int64)})

    left = self_pairs(rows, n, tally, "d2 double, n bigint").groupBy("d2").agg(F.sum("n").alias("n")).orderBy("d2").collect()
    upto = below + np.cumsum([r["n"] for r in left])
    return float(np.mean([left[int(np.searchsorted(upto, r, side="right"))]["d2"] for r in ranks]))


# ---- weight vectors


def _tagged(reference: DataFrame, pool: DataFrame) -> list[DataFrame]:
    """Both sides under keys of their own; the same row may stand on both."""
    return [
        df.select(F.concat_ws(":", F.lit(side), F.col("row_id").cast("string")).alias("row_id"), "v")
        for side, df in (("r", reference), ("t", pool))
    ]


def _relabelled_items(reference: DataFrame, weights: DataFrame, n_permutations: int, seed: int) -> DataFrame:
    """(keys..., perm, row_id, copy, _h): every copy of a row under every relabelling, with its hash."""
    keys = weight_keys(weights)
    grid, n_keys = weight_columns(weights)  # one row per resample of the run grid
    ref_items = (
        reference.select(
            F.concat_ws(":", F.lit("r"), F.col("row_id").cast("string")).alias("row_id"), spread(0, n_keys - 1).alias("col")
        )
        .join(F.broadcast(grid), "col")
        .drop("col")
    )
    pool_items = weights.select(
        F.concat_ws(":", F.lit("t"), F.col("row_id").cast("string")).alias("row_id"),
        *keys,
        F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("copy"),
    )
    items = ref_items.withColumn("copy", F.lit(1)).unionByName(pool_items)
    return items.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1)))).withColumn(
        "_h", hash_key(*_draw_parts(keys, seed), F.col("perm"), F.col("row_id"), F.col("copy"))
    )


def _draw_parts(keys: list[str], seed: int) -> list[Column | str | int]:
    """Leading parts of a relabelling's hash key; the same for all intensities."""
    return ["perm", seed, *[F.col(k) for k in keys if k != "alpha"]]


def relabelling_cuts(reference: DataFrame, weights: DataFrame, n_permutations: int, *, seed: int = 42) -> DataFrame:
    """(keys..., perm, cut): the m-th smallest hash of each relabelling, m being the reference
    size; copies up to it stand on the reference side. A histogram of leading hash digits finds
    the one bucket in which the cut lies, and only that bucket is ranked. The result has a
    row for each resample and relabelling, whatever the number of rows."""
    keys = weight_keys(weights)
    m = reference.count()
    group = [*keys, "perm"]
    hashed = _relabelled_items(reference, weights, n_permutations, seed).select(
        *group, "_h", F.substring("_h", 1, LABEL_DIGITS).alias("_b")
    )
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_b"))
    cut = cut_lineage(
        hashed.groupBy(*group, "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", upto)
        .filter((F.col("_upto") >= m) & (F.col("_upto") - F.col("_n") < m))
        .select(*group, "_b", (F.lit(m) - F.col("_upto") + F.col("_n")).alias("_take"))
    )
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_h"))
    return (
        hashed.join(F.broadcast(cut), [*group, "_b"])
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_take"))
        .select(*group, F.col("_h").alias("cut"))
    )


def relabelled_counts(
    reference: DataFrame, pool: DataFrame, weights: DataFrame, n_permutations: int, *, seed: int = 42
) -> DataFrame:
    """(keys..., perm, row_id, n): how many copies of a row each relabelling puts on the
    reference side. The detectors do not need this table: their tasks hash their own rows."""
    group = [*weight_keys(weights), "perm"]
    cuts = relabelling_cuts(reference, weights, n_permutations, seed=seed)
    items = _relabelled_items(reference, weights, n_permutations, seed)
    return items.join(F.broadcast(cuts), group).filter("_h <= cut").groupBy(*group, "row_id").agg(F.count("*").alias("n"))


@dataclass
class _Draws:
    """Heads of the hash keys, one a resample, and the cuts (resample x relabelling x two halves of 128 bits)."""

    heads: list[str]
    cuts: np.ndarray

    def add(self, ids: list[str], copies: np.ndarray, first: int, moved: np.ndarray) -> None:
        """Add to ``moved`` (row x resample x relabelling) the copies of each row that stand on the
        reference side; ``copies`` is row x resample. Resamples with one head share their hashes."""
        shared: dict[str, list[int]] = {}
        for at in range(copies.shape[1]):
            shared.setdefault(self.heads[first + at], []).append(at)
        for head, members in shared.items():
            most = copies[:, members].max(axis=1, initial=0)
            for copy in range(1, int(most.max(initial=0)) + 1):
                rows = np.flatnonzero(most >= copy)
                tails = [f":{ids[i]}:{copy}".encode() for i in rows]
                for perm in range(moved.shape[2]):
                    start = f"{head}:{perm}".encode()
                    hashes = np.frombuffer(b"".join([md5(start + t).digest() for t in tails]), ">u8").reshape(-1, 2)
                    for at in members:
                        high, low = self.cuts[first + at, perm]
                        under = (hashes[:, 0] < high) | ((hashes[:, 0] == high) & (hashes[:, 1] <= low))
                        moved[rows, at, perm] += under & (copies[rows, at] >= copy)


@dataclass
class _Vectors:
    """Makes the weight vectors of a block of rows, in a task."""

    per_chunk: int
    n_keys: int
    n_permutations: int
    draws: _Draws | None

    def of(self, table: pa.Table, chunk: int) -> np.ndarray:
        """rows x columns of one chunk; small whole numbers."""
        first = chunk * self.per_chunk
        n = min(self.per_chunk, self.n_keys - first)
        ids = table.column("row_id").to_pylist()
        out = np.zeros((len(ids), 1 + self.per_chunk * (1 + self.n_permutations)), np.float32)
        cols, ws = as_array(table.column("cols")), as_array(table.column("ws"))
        at = np.asarray(cols.flatten(), dtype=np.int64) - first
        rows = np.repeat(np.arange(len(ids)), np.asarray(cols.value_lengths(), dtype=np.int64))
        here = (at >= 0) & (at < n)
        out[rows[here], 1 + at[here]] = np.asarray(ws.flatten())[here]
        out[:, 0] = [i.startswith("r:") for i in ids]
        if self.draws is not None:
            copies = (out[:, 1 : 1 + n] + out[:, :1]).astype(np.int64)
            moved = out[:, 1 + self.per_chunk :].reshape(len(ids), self.per_chunk, self.n_permutations)
            added = np.zeros(moved.shape, np.float32)
            self.draws.add(ids, copies, first, added)
            moved += added
            out[:, 1 + self.per_chunk :] = moved.reshape(len(ids), -1)
        return out


class _Columns:
    """Layout of the weight vectors: per chunk the reference, then the resamples, then
    their relabellings. Rows carry their resamples only; ``vectors`` makes the matrix of a
    block in the task and draws the relabellings there, from the cuts."""

    def __init__(self, weights: DataFrame, n_permutations: int):
        self.keys = weight_keys(weights)
        self.table, self.n_keys = weight_columns(weights)
        self.n_permutations = n_permutations
        self.per_chunk = max(1, min(self.n_keys, CHUNK_COLUMNS // (1 + n_permutations)))
        self.n_chunks = -(-self.n_keys // self.per_chunk)
        self.width = 1 + self.per_chunk * (1 + n_permutations)

    def rows(self, reference: DataFrame, pool: DataFrame, weights: DataFrame) -> DataFrame:
        """(row_id, v, cols, ws): tagged rows of both sides with the resamples they occur in."""
        tagged = packed_weights(weights, self.table).withColumn(
            "row_id", F.concat_ws(":", F.lit("t"), F.col("row_id").cast("string"))
        )
        nothing = [F.array().cast(f"array<{kind}>").alias(c) for c, kind in (("cols", "int"), ("ws", "double"))]
        ref, own = _tagged(reference, pool)
        return ref.select("row_id", "v", *nothing).unionByName(own.join(tagged, "row_id").select("row_id", "v", "cols", "ws"))

    def draws(self, reference: DataFrame, weights: DataFrame, seed: int) -> _Draws | None:
        """What the tasks need to relabel rows: a hash per resample and relabelling."""
        if not self.n_permutations:
            return None
        heads = self.table.select("col", hash_text(*_draw_parts(self.keys, seed)).alias("head")).collect()
        cuts = relabelling_cuts(reference, weights, self.n_permutations, seed=seed).join(F.broadcast(self.table), self.keys)
        limits = np.zeros((self.n_keys, self.n_permutations, 2), np.uint64)
        for r in cuts.select("col", "perm", "cut").collect():
            limits[r["col"], r["perm"]] = int(r["cut"][:16], 16), int(r["cut"][16:], 16)
        return _Draws([r["head"] for r in sorted(heads)], limits)

    def vectors(self, draws: _Draws | None) -> _Vectors:
        return _Vectors(self.per_chunk, self.n_keys, self.n_permutations, draws)

    def col(self) -> Column:
        """Resample number of a (chunk, at) row."""
        k, p = self.per_chunk, self.n_permutations
        local = F.when(F.col("at") <= k, F.col("at") - 1).otherwise(F.floor((F.col("at") - 1 - k) / max(p, 1)))
        return (F.col("chunk") * k + local).cast("int")

    def perm(self) -> Column:
        return F.pmod(F.col("at") - 1 - self.per_chunk, F.lit(max(self.n_permutations, 1))).cast("int")


# ---- maximum mean discrepancy


def _totals(w: np.ndarray, per_chunk: int, n_permutations: int) -> np.ndarray:
    """For every column the vector its cross term is taken with: the reference for a
    resample, reference plus resample for a relabelling."""
    ref, resamples = w[:, :1], w[:, 1 : 1 + per_chunk]
    moved = np.repeat(ref + resamples, n_permutations, axis=1)
    return np.concatenate([ref, np.repeat(ref, per_chunk, axis=1), moved], axis=1)


def _kernel_forms(rows: DataFrame, layout: _Columns, draws: _Draws | None, gamma: float, block_rows: int) -> DataFrame:
    """(chunk, at, quad, cross): w'Kw and w'Kt for every weight vector, from the blocks on
    and above the diagonal. A task walks the blocks of two groups, chunk by chunk; where
    groups are few, chunks are dealt to several tasks ("lanes")."""
    rows = cut_lineage(rows)
    busy = rows.sparkSession.sparkContext.defaultParallelism
    groups = triangle_groups(n_blocks(rows.count(), block_rows), busy)
    lanes = min(layout.n_chunks, max(1, -(-2 * busy // (groups * (groups + 1)))))
    left, right = (side.withColumn("_lane", spread(0, lanes - 1)) for side in triangle(rows, groups))
    width, per_chunk, n_permutations, n_chunks = layout.width, layout.per_chunk, layout.n_permutations, layout.n_chunks
    vectors = rows.sparkSession.sparkContext.broadcast(layout.vectors(draws))
    schema = "chunk int, at int, quad double, cross double"
    empty = empty_table(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not (b.num_rows or diagonal(a)):
            return empty
        lane, out = a.column("_lane")[0].as_py(), []
        for chunk in range(lane, n_chunks, lanes):
            sides = [[(Block.of(t), vectors.value.of(t, chunk)) for t in pieces(side, block_rows)] for side in (a, b)]
            quad, cross = np.zeros(width), np.zeros(width)
            for (x, wx), (y, wy), times in block_pairs(*sides):
                k = np.exp(-gamma * squared_distances(x.x, y.x))
                wx, wy = wx.astype(np.float64), wy.astype(np.float64)
                kw = k @ wy
                quad += times * np.einsum("ij,ij->j", wx, kw)
                cross += np.einsum("ij,ij->j", _totals(wx, per_chunk, n_permutations), kw)
                if times == 2:
                    cross += np.einsum("ij,ij->j", wx, k @ _totals(wy, per_chunk, n_permutations))
            out.append(pa.table({"chunk": np.full(width, chunk, np.int32), "at": np.arange(width, dtype=np.int32), "quad": quad, "cross": cross}))
        return pa.concat_tables(out) if out else empty

    key = ["_lane", "_i", "_j"]
    forms = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)
    # one row per weight vector, read several times below
    return cut_lineage(forms.groupBy("chunk", "at").agg(F.sum("quad").alias("quad"), F.sum("cross").alias("cross")))


def mmd_statistics(
    reference: DataFrame,
    pool: DataFrame,
    weights: DataFrame | None = None,
    *,
    n_permutations: int = 0,
    median_d2: float | None = None,
    seed: int = 42,
    block_rows: int = KERNEL_BLOCK_ROWS,
) -> DataFrame:
    """(keys..., perm, mmd2): unbiased squared discrepancy with a Gaussian kernel whose
    width comes from the reference; perm is null for the observed labels."""
    weights = unit_weights(pool) if weights is None else weights
    median_d2 = median_squared_distance(reference) if median_d2 is None else median_d2
    layout = _Columns(weights, n_permutations)
    draws = layout.draws(reference, weights, seed)
    gamma = 1.0 / median_d2 if median_d2 > 0 else 0.0
    forms = _kernel_forms(layout.rows(reference, pool, weights), layout, draws, gamma, block_rows)
    k = layout.per_chunk
    own = forms.filter(F.col("at") == 0).select("chunk", F.col("quad").alias("rr"))
    sizes = weights.groupBy(*layout.keys).agg(F.sum("w").cast("double").alias("n"))
    observed = (
        forms.filter((F.col("at") > 0) & (F.col("at") <= k))
        .select("chunk", layout.col().alias("col"), F.col("quad").alias("tt"), F.col("cross").alias("rt"))
        .join(own, "chunk")
        .join(layout.table, "col")
        .join(sizes, layout.keys)
        .withColumn("m", F.lit(float(reference.count())))
    )
    a, b, ab = F.col("rr"), F.col("tt"), F.col("rt")
    result = observed.select(*layout.keys, F.lit(None).cast("int").alias("perm"), _mmd2(a, b, ab).alias("mmd2"))
    if not n_permutations:
        return result
    uu, ut = F.col("quad"), F.col("cross")
    everything = a + 2 * ab + b
    moved = (
        forms.filter(F.col("at") > k)
        .select(layout.col().alias("col"), layout.perm().alias("perm"), "quad", "cross")
        .join(observed, "col")
        .select(*layout.keys, "perm", _mmd2(uu, everything - 2 * ut + uu, ut - uu).alias("mmd2"))
    )
    return result.unionByName(moved)


def _mmd2(aa: Column, bb: Column, ab: Column) -> Column:
    m, n = F.col("m"), F.col("n")
    return (aa - m) / (m * (m - 1)) + (bb - n) / (n * (n - 1)) - 2 * ab / (m * n)


def permutation_scores(statistics: DataFrame, keys: list[str], statistic: str) -> DataFrame:
    """(keys..., statistic, p_value, score) from observed and relabelled statistics."""
    observed = statistics.filter(F.col("perm").isNull()).select(*keys, F.col(statistic).alias("_seen"))
    moved = statistics.filter(F.col("perm").isNotNull()).join(observed, keys)
    return (
        moved.groupBy(*keys)
        .agg(
            F.max("_seen").alias(statistic),
            F.avg((F.col(statistic) >= F.col("_seen")).cast("double")).alias("p_value"),
        )
        .withColumn("score", F.lit(1.0) - F.col("p_value"))
    )


def mmd_scores(
    reference: DataFrame,
    pool: DataFrame,
    weights: DataFrame | None = None,
    *,
    n_permutations: int = 100,
    seed: int = 42,
    median_d2: float | None = None,
) -> DataFrame:
    """(keys..., mmd2, p_value, score)."""
    weights = unit_weights(pool) if weights is None else weights
    stats = mmd_statistics(
        reference, pool, weights, n_permutations=n_permutations, seed=seed, median_d2=median_d2
    )
    return permutation_scores(stats, weight_keys(weights), "mmd2")


# ---- least-squares density difference


def lsdd_statistics(
    reference: DataFrame,
    pool: DataFrame,
    weights: DataFrame | None = None,
    *,
    n_permutations: int = 0,
    n_centres: int = 100,
    ridge: float = 1e-3,
    median_d2: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """(keys..., perm, lsdd). Centres are sampled from the reference, at most
    ``MAX_CENTRES`` of them (a parameter of the method); their matrix is solved in the
    tasks that need it. The common factor (pi sigma^2)^(d/2) of the normal matrix is left out."""
    if n_centres > MAX_CENTRES:
        raise ValueError(f"at most {MAX_CENTRES} centres")
    weights = unit_weights(pool) if weights is None else weights
    median_d2 = median_squared_distance(reference) if median_d2 is None else median_d2
    sigma2 = max(median_d2 / 2.0, np.finfo(float).tiny)
    centres = Block.of(sample_rows(reference.select("row_id", "v"), "row_id", n_centres, seed=seed, tag="centres").toArrow()).x
    layout = _Columns(weights, n_permutations)
    draws = layout.draws(reference, weights, seed)
    sc = reference.sparkSession.sparkContext
    shared, vectors, n_chunks = sc.broadcast(centres), sc.broadcast(layout.vectors(draws)), layout.n_chunks

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for table in pieces(pa.Table.from_batches([batch]), KERNEL_BLOCK_ROWS):
                k = np.exp(-squared_distances(Block.of(table).x, c) / (2.0 * sigma2))
                for chunk in range(n_chunks):
                    sums[chunk] = sums.get(chunk, 0.0) + vectors.value.of(table, chunk).astype(np.float64).T @ k
        for chunk, h in sums.items():
            n = h.shape[0]
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": np.full(n * len(c), chunk, dtype=np.int32),
                    "at": np.repeat(np.arange(n, dtype=np.int32), len(c)),
                    "pos": np.tile(np.arange(len(c), dtype=np.int32), n),
                    "h": h.ravel(),
                }
            )

    rows = layout.rows(reference, pool, weights).repartition(sc.defaultParallelism)
    parts = rows.mapInArrow(project, "chunk int, at int, pos int, h double")
    sums = cut_lineage(parts.groupBy("chunk", "at", "pos").agg(F.sum("h").alias("h")))
    k = layout.per_chunk
    own = sums.filter(F.col("at") == 0).select("chunk", "pos", F.col("h").alias("hr"))
    sizes = weights.groupBy(*layout.keys).agg(F.sum("w").cast("double").alias("n"))
    seen = (
        sums.filter((F.col("at") > 0) & (F.col("at") <= k))
        .select("chunk", "pos", layout.col().alias("col"), F.col("h").alias("ht"))
        .join(own, ["chunk", "pos"])
        .join(layout.table, "col")
        .join(sizes, layout.keys)
        .withColumn("m", F.lit(float(reference.count())))
    )
    keys = layout.keys
    differences = seen.select(
        *keys, F.lit(None).cast("int").alias("perm"), "pos", (F.col("hr") / F.col("m") - F.col("ht") / F.col("n")).alias("h")
    )
    if n_permutations:
        moved = (
            sums.filter(F.col("at") > k)
            .select("pos", layout.col().alias("col"), layout.perm().alias("perm"), "h")
            .join(seen, ["col", "pos"])
            .select(
                *keys,
                "perm",
                "pos",
                (F.col("h") / F.col("m") - (F.col("hr") + F.col("ht") - F.col("h")) / F.col("n")).alias("h"),
            )
        )
        differences = differences.unionByName(moved)
    # solved in the Python workers: linear algebra with threads can hang in the driver's process beside the JVM
    @F.pandas_udf(DoubleType())
    def quadratic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        form = density_difference_form(shared.value, sigma2, ridge)
        for h in batches:
            vectors = np.stack(h.to_numpy()) if len(h) else np.zeros((0, len(form)))
            yield pd.Series(np.einsum("ij,ij->i", vectors @ form, vectors))

    # one row per resample or relabelling, each with an array of at most MAX_CENTRES numbers
    ordered = F.sort_array(F.collect_list(F.struct("pos", "h")))
    arrays = differences.groupBy(*keys, "perm").agg(ordered.alias("e"))
    return arrays.select(*keys, "perm", quadratic(F.col("e.h")).alias("lsdd"))


def density_difference_form(centres: np.ndarray, sigma2: float, ridge: float) -> np.ndarray:
    """Matrix A with LSDD = h'Ah = 2 theta'h - theta'H theta, theta = (H + ridge I)^-1 h."""
    normal = np.exp(-squared_distances(centres, centres) / (4.0 * sigma2))
    solve = np.linalg.inv(normal + ridge * np.eye(len(centres)))
    return 2.0 * solve - solve @ normal @ solve


def lsdd_scores(
    reference: DataFrame,
    pool: DataFrame,
    weights: DataFrame | None = None,
    *,
    n_permutations: int = 100,
    n_centres: int = 100,
    ridge: float = 1e-3,
    seed: int = 42,
    median_d2: float | None = None,
) -> DataFrame:
    """(keys..., lsdd, p_value, score)."""
    weights = unit_weights(pool) if weights is None else weights
    stats = lsdd_statistics(
        reference,
        pool,
        weights,
        n_permutations=n_permutations,
        n_centres=n_centres,
        ridge=ridge,
        seed=seed,
        median_d2=median_d2,
    )
    return permutation_scores(stats, weight_keys(weights), "lsdd")
