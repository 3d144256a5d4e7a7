"""Whitening of embeddings by incremental eigendecomposition.

Each task keeps the spectrum (eigenvalues and eigenvectors) of the scatter matrix of its rows. A centred row is a
rank-one update: the secular equation gives the new eigenvalues, parts of the spectrum that the row does not move
are deflated, and eigenvectors follow from the roots. A block with more rows than dimensions first becomes the rows
of its triangular factor, which have the same scatter. Spectra of tasks meet in groups of FAN, level by level: one
is updated by the scaled eigenvectors of the others. The joint basis then spans a Rayleigh-Ritz step over all rows:
the rows' projections give a small, nearly diagonal matrix whose eigenvectors refine the basis to double precision.

Tasks and driver hold matrices of dimensions times dimensions, whatever the number of rows. Counts, sums and
deviations are exact integers; rows are centred before anything is multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.shared import partitions
from driftwell.session import cut_lineage

EPS = np.finfo(float).eps
#: Rows whose triangular factor is made at once; spectra that meet in one task; steps of a root's bisection.
BLOCK_ROWS, FAN, STEPS = 2048, 16, 64
SCALE, SHIFT = 64, 1_000_000
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(64 c) + 1000000 of each entry; vectors null, or with a null or non-finite entry, go."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(good).select(
        F.col(f"`{key}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE) + SHIFT).alias("x")
    )


def _deflated(values: np.ndarray, z: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Places that the update moves. Within equal eigenvalues a reflection leaves one place with all of z."""
    size = float(z @ z)
    tol = 8 * EPS * max(abs(values[0]), abs(values[-1]), size)
    cut = np.flatnonzero(np.concatenate(([True], np.diff(values) > tol, [True])))
    for a, b in zip(cut, cut[1:], strict=False):
        if b - a > 1:
            w, length = z[a:b].copy(), float(np.linalg.norm(z[a:b]))
            to = -length if w[-1] > 0 else length
            w[-1] -= to
            if (square := float(w @ w)) > 0:
                vectors[:, a:b] -= np.outer(vectors[:, a:b] @ w, w * (2 / square))
                z[a:b] = 0
                z[b - 1] = to
    return np.flatnonzero(np.abs(z) * np.sqrt(size) > tol)


def _roots(d: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Matrix of root j minus d_i for the roots of 1 + sum z_i^2 / (d_i - x) = 0, d rising, no z_i zero.

    Root j lies between d_j and the next d. It is searched as a distance from the nearer end, in even steps of its
    logarithm, so that small distances are right to the last digits too.
    """
    square, k = z * z, len(d)
    gap = np.append(np.diff(d), square.sum())
    middle = d + gap / 2
    left = 1 + (square / (d - middle[:, None])).sum(1) > 0
    left[-1] = True
    origin = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    away = d - d[origin][:, None]  # of row j: each d_i from the root's origin
    sign = np.where(left, 1.0, -1.0)
    low, high = np.log(gap) - 460.0, np.log(gap)
    for _ in range(STEPS):
        tau = sign * np.exp((low + high) / 2)
        with np.errstate(divide="ignore"):
            f = 1 + (square / (away - tau[:, None])).sum(1)
        far = (f > 0) == left  # the root is nearer to its origin than tau
        high, low = np.where(far, (low + high) / 2, high), np.where(far, low, (low + high) / 2)
    return (sign * np.exp((low + high) / 2))[:, None] - away


def rank_one(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of vectors diag(values) vectors' + row row'."""
    z = vectors.T @ row
    if not float(z @ z) > 0:
        return values, vectors
    vectors = vectors.copy()
    at = _deflated(values, z, vectors)
    if not len(at):
        return values, vectors
    d = values[at]
    apart = _roots(d, z[at])  # [j, i]: root j minus d_i
    values = values.copy()
    nearest = np.argmin(np.abs(apart), axis=1)
    values[at] = d[nearest] + apart[np.arange(len(at)), nearest]
    # the z for which these roots are exact keeps the eigenvectors orthogonal
    ratio = d[:, None] - d[None, :]
    np.fill_diagonal(ratio, 1.0)
    exact = np.copysign(np.sqrt(np.abs(np.prod(apart / ratio, axis=0))), z[at])
    small = exact[:, None] / apart.T
    vectors[:, at] = vectors[:, at] @ (small / np.linalg.norm(small, axis=0))
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def updated(values: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum after all ``rows``, centred."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    for row in rows:
        values, vectors = rank_one(values, vectors, row)
    return values, vectors


def _rows(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """x minus the mean whole + part: the integer difference is exact."""
    return (x - whole).astype(float) - part


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            held.append(_rows(batch.slice(a, BLOCK_ROWS), dimensions))
            n += len(held[-1])
            if n >= BLOCK_ROWS:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _packed(*arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel() for a in arrays]).tolist()])], names=["data"])


def _sums(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]):
        n, total = 0, np.zeros(dimensions, np.int64)
        for x in _blocks(batches, dimensions):
            n, total = n + len(x), total + x.sum(0)
        if n:
            yield _packed(np.array([n]), total)

    return run


def _spectrum(whole: np.ndarray, part: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]):
        d = len(whole)
        values, vectors, some = np.zeros(d), np.eye(d), False
        for x in _blocks(batches, d):
            values, vectors, some = *updated(values, vectors, _centred(x, whole, part)), True
        if some:
            yield _packed(values, vectors)

    return run


def _projected(whole: np.ndarray, part: np.ndarray, basis: np.ndarray):
    """Sum of the outer products of all rows' projections on ``basis`` (columns)."""

    def run(batches: Iterator[pa.RecordBatch]):
        total, some = np.zeros((basis.shape[1], basis.shape[1])), False
        for x in _blocks(batches, len(whole)):
            y = _centred(x, whole, part) @ basis
            total, some = total + y.T @ y, True
        if some:
            yield _packed(total)

    return run


def _join_spectra(dimensions: int):
    def fold(held: np.ndarray, data: np.ndarray) -> np.ndarray:
        d = dimensions
        values, vectors = held[:d], held[d:].reshape(d, d)
        more, axes = np.maximum(data[:d], 0), data[d:].reshape(d, d)
        for i in np.flatnonzero(more):
            values, vectors = rank_one(values, vectors, np.sqrt(more[i]) * axes[:, i])
        return np.concatenate([values, vectors.ravel()])

    return fold


def _folded(fold):
    """One row per group from rows sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]):
        group, held = None, None
        for batch in batches:
            groups, data = batch.column("part").to_pylist(), batch.column("data")
            for i, g in enumerate(groups):
                now = data[i].values.to_numpy()
                if held is not None and g == group:
                    held = fold(held, now)
                    continue
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([held.tolist()])], names=["part", "data"])
                group, held = g, now
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([held.tolist()])], names=["part", "data"])

    return run


def _met(parts: DataFrame, fold) -> np.ndarray | None:
    """All rows of ``parts`` (data) folded into one, FAN of them at a time; each level is a written table."""
    rows = cut_lineage(parts.select(F.spark_partition_id().cast("long").alias("part"), "data"))
    count = rows.agg(F.max("part")).first()[0]
    if count is None:
        return None
    while True:
        rows = rows.withColumn("part", F.expr(f"part div {FAN}"))
        count //= FAN
        width = max(1, min(partitions(parts.sparkSession), count + 1))
        rows = rows.repartition(width, "part").sortWithinPartitions("part").mapInArrow(_folded(fold), "part long, data array<double>")
        if count == 0:
            return np.array(rows.first()["data"])
        rows = cut_lineage(rows)


def _deviations(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> pa.Array:
    """Exact sum over dimensions of (n x - S)^2, S = n whole + rest, as decimals."""
    y = x - whole
    bound = n * (int(np.abs(y).max(initial=0)) + 1)
    kind = np.int64 if x.shape[1] * bound * bound < 1 << 62 else object
    t = n * y.astype(kind) - rest.astype(kind)
    return pa.array([int(v) for v in (t * t).sum(1).tolist()], pa.decimal128(38, 0))


def _whitened(n: int, whole: np.ndarray, rest: np.ndarray, axes: np.ndarray):
    """(vec_id, deviation, w): w are the coordinates along ``axes`` (columns, scaled)."""
    part = rest / n

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(a, BLOCK_ROWS)
                x = _rows(b, len(whole))
                w = _centred(x, whole, part) @ axes
                lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * axes.shape[1], w.ravel())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), _deviations(x, whole, rest, n), lists], names=["vec_id", "deviation", "w"])

    return run


def _gram(batches: Iterator[pa.RecordBatch]):
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        found = np.concatenate([w.sum(0), (w.T @ w).ravel()])
        total = found if total is None else total + found
    if total is not None:
        yield _packed(total)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``vectors`` (vec_id, x array<long>).

    A row for each vector and each of the first ``components`` principal components (all, if there are fewer
    dimensions), from 1 by falling eigenvalue; signs are free but the same in all rows. Vectors of the commonest
    length take part (of equally common ones the longest), others and empty ones do not. Rows without or with a
    repeated vec_id count and are returned one by one. Where an eigenvalue is zero to double precision whitened is
    null and takes no part in identity_error; where all are (one vector, or all equal) explained is null too, as is
    identity_error. An empty table gives no rows. Entries must keep sums over a task's rows within 64 bits.
    """
    spark = vectors.sparkSession
    common = vectors.filter("size(x) > 0").groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], OUT)
    d = common["d"]
    rows = vectors.filter(F.size("x") == d)
    # one row of sums per task; adding them up leaves d + 1 numbers
    sums = rows.select("x").mapInArrow(_sums(d), "data array<long>").select(F.posexplode("data").alias("at", "s"))
    sums = {r["at"]: int(r["s"]) for r in sums.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n, totals = sums[0], [sums[i + 1] for i in range(d)]
    whole, rest = np.array([s // n for s in totals]), np.array([s % n for s in totals])
    part = rest / n
    spectrum = _met(rows.select("x").mapInArrow(_spectrum(whole, part), "data array<double>"), _join_spectra(d))
    basis, _ = np.linalg.qr(spectrum[d:].reshape(d, d)[:, ::-1])
    ritz = _met(rows.select("x").mapInArrow(_projected(whole, part, basis), "data array<double>"), _add)
    values, turn = np.linalg.eigh(ritz.reshape(d, d) / n)
    values, axes = np.maximum(values[::-1], 0), (basis @ turn)[:, ::-1]
    trace, k = values.sum(), min(components, d)
    live = values[:k] > d * EPS * values[0]
    scaled = axes[:, :k] / np.sqrt(np.where(live, values[:k], 1))
    table = cut_lineage(rows.mapInArrow(_whitened(n, whole, rest, scaled), "vec_id long, deviation decimal(38,0), w array<double>"))
    error = None
    if live.any():
        found = _met(table.select("w").mapInArrow(_gram, "data array<double>"), _add)
        mean, second = found[:k] / n, found[k:].reshape(k, k) / n
        off = np.abs(second - np.outer(mean, mean) - np.eye(k))
        error = float(off[np.ix_(live, live)].max())
    share = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values[:k]])
    alive = F.array(*[F.lit(bool(v)) for v in live])
    return table.select("vec_id", "deviation", F.posexplode("w").alias("at", "w")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.get(alive, F.col("at")), F.col("w")).alias("whitened"),
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    found = whiten(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
