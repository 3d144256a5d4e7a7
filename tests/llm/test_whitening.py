"""Whitening against a plain dense decomposition, the rank-one update by itself, and odd inputs."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from driftwell.llm import whitening

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def check_spectrum(values, vectors, scatter):
    scale = max(1.0, np.abs(scatter).max())
    assert (np.diff(values) >= 0).all()
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs((vectors * values) @ vectors.T - scatter).max() < 1e-11 * scale


@pytest.mark.parametrize("case", ["random", "repeated", "axes", "ties", "scales", "zero"])
def test_rank_one_updates(case):
    rng = np.random.default_rng(5)
    d = 12
    rows = {
        "random": rng.normal(size=(40, d)),
        "repeated": np.repeat(rng.normal(size=(2, d)), 10, axis=0),
        "axes": np.eye(d)[rng.integers(0, d, 30)],
        "ties": rng.integers(-1, 2, size=(60, d)).astype(float),
        "scales": rng.normal(size=(40, d)) * 10.0 ** np.arange(-6, 6),
        "zero": np.zeros((3, d)),
    }[case]
    values, vectors, scatter = np.zeros(d), np.eye(d), np.zeros((d, d))
    for row in rows:
        values, vectors = whitening.rank_one(values, vectors, row)
        scatter += np.outer(row, row)
        check_spectrum(values, vectors, scatter)
    check_spectrum(*whitening.updated(np.zeros(d), np.eye(d), rows), scatter)


def plain(x: np.ndarray):
    n = len(x)
    total = [sum(int(v) for v in c) for c in x.T]
    dev = [sum((n * int(v) - s) ** 2 for v, s in zip(r, total, strict=True)) for r in x]
    y = x - np.array([s // n for s in total]) - np.array([s % n for s in total]) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return n, dev, e[::-1], v[:, ::-1], y


def check_rows(found, keys, x, components):
    n, dev, e, v, y = plain(x)
    k = min(components, x.shape[1])
    assert len(found) == n * k
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = None
    for i, key in enumerate(keys):
        rows = [by[key][c + 1] for c in range(k)]
        assert all(r["n"] == n and int(r["deviation"]) == dev[i] for r in rows)
        assert np.allclose([r["explained"] for r in rows], e[:k] / e.sum(), rtol=1e-9, atol=1e-15)
        w = np.array([np.nan if r["whitened"] is None else r["whitened"] for r in rows])
        live = ~np.isnan(w)
        assert (live == (e[:k] > 1e-12 * e[0])).all()
        expected = y[i] @ v[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300))
        now = np.where(np.abs(w) > 1e-3, np.sign(w) * np.sign(expected), 0)
        signs = now if signs is None else np.where(signs == 0, now, signs)
        assert np.allclose(np.abs(w[live]), np.abs(expected[live]), atol=1e-6)
        assert (now[live] * signs[live] >= 0).all()
        assert rows[0]["identity_error"] < 1e-9


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_query_is_the_dense_decomposition(spark):
    data = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in r["embedding"]] for r in data])
    found = whitening.query(spark, SF_DIR)
    assert dict(found.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double",
    }
    check_rows(found.collect(), [r["vec_id"] for r in data], x, 32)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(v) for v in rng.normal(size=5).astype(np.float32)], 0) for i in range(60)]
    good += [(100 + i, good[3][1], 0) for i in range(30)]  # copies
    bad = [(900, None, 0), (901, [], 0), (902, [1.0, None, 1.0, 1.0, 1.0], 0), (903, [float("nan")] * 5, 0), (904, [float("inf")] * 5, 0), (905, [1.0, 2.0], 0)]
    df = spark.createDataFrame(good + bad, SCHEMA).repartition(7)
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v, _ in good])
    check_rows(whitening.whiten(whitening.quantised(df)).collect(), [g[0] for g in good], x, 32)
    assert {r["component"] for r in whitening.whiten(whitening.quantised(df), components=2).collect()} == {1, 2}


def test_flat_directions_and_single_rows(spark):
    flat = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(20)]
    x = np.array([[64 * i + 1_000_000, 128 * i + 1_000_000, 1_000_064] for i in range(20)])
    check_rows(whitening.whiten(whitening.quantised(spark.createDataFrame(flat, SCHEMA))).collect(), range(20), x, 32)
    one = whitening.whiten(whitening.quantised(spark.createDataFrame(flat[:1], SCHEMA))).collect()
    assert len(one) == 3 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in one)
    repeated = whitening.whiten(whitening.quantised(spark.createDataFrame([(None, [1.0, 2.0], 0), (None, [2.0, 1.0], 0), (4, [3.0, 3.0], 0), (4, [3.0, 3.0], 0)], SCHEMA))).collect()
    assert len(repeated) == 8 and sum(r["vec_id"] is None for r in repeated) == 4
    assert whitening.whiten(whitening.quantised(spark.createDataFrame([], SCHEMA))).count() == 0


def test_deviation_beyond_64_bits():
    x = np.array([[1_000_000, 3], [5, 2_000_000]])
    whole, rest, n = np.array([7, 9]), np.array([5, 11]), 10**12
    assert [int(v.as_py()) for v in whitening._deviations(x, whole, rest, n)] == [sum((n * int(v) - (n * int(a) + int(b))) ** 2 for v, a, b in zip(r, whole, rest, strict=True)) for r in x]
