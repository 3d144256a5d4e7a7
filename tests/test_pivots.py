"""The pivot index against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import pairs, pivots


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id bigint, v array<double>")


def clustered(rng, n, centres=12, width=6):
    return rng.normal(size=(centres, width))[rng.integers(centres, size=n)] * 20 + rng.normal(size=(n, width))


def dist(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


def test_lists_equal_all_distances_and_few_pairs_meet(spark, monkeypatch):
    monkeypatch.setattr(pivots, "GROUP_ROWS", 40)
    rng = np.random.default_rng(3)
    y = clustered(rng, 700)
    y[:230] = y[0]  # a third of all rows is one vector: one cell, several groups
    x = np.concatenate([y[200:400], clustered(rng, 60), [[500.0] * 6]])
    found = pivots.indexed_nearest_rows(frame(spark, x), frame(spark, y), 9)
    assert found.share < 0.5
    d, got = dist(x, y), {}
    for r in found.near.collect():
        assert r["d"] == pytest.approx(d[r["row_id"], r["other"]], abs=1e-9)
        got.setdefault(r["row_id"], []).append((r["d"], r["other"]))
    assert set(got) == set(range(len(x)))
    for i, near in got.items():
        assert len(set(near)) == 9
        assert sorted(e[0] for e in near) == pytest.approx(list(np.sort(d[i])[:9]), abs=1e-9)


def test_data_without_structure_is_left_to_the_grid(spark):
    x = np.random.default_rng(4).normal(size=(300, 40))
    found = pivots.indexed_nearest_rows(frame(spark, x), frame(spark, x), 5)
    assert found.near is None and found.share > 0.5
    kth = {r["row_id"]: r["kth_distance"] for r in pairs.nearest_distances(frame(spark, x), frame(spark, x), 5, share=False, index=True).collect()}
    assert [kth[i] for i in range(300)] == pytest.approx(list(np.sort(dist(x, x), 1)[:, 4]))


def test_fewer_rows_than_asked_for_and_none(spark):
    x = np.array([[0.0], [1.0], [1.0], [5.0]])
    found = pivots.indexed_nearest_rows(frame(spark, x), frame(spark, x), 9, worth=1.0)
    assert found.near.count() == 16
    none = frame(spark, x).filter("row_id < 0")
    assert pivots.indexed_nearest_rows(none, frame(spark, x), 2).near.count() == 0
    assert pivots.indexed_nearest_rows(frame(spark, x), none, 2).near.count() == 0


def test_distances_through_the_index(spark):
    x = clustered(np.random.default_rng(6), 500)
    rows = frame(spark, x)
    got = pairs.nearest_distances(rows, rows, 5, share=False, index=True).agg(F.count("*"), F.sum("kth_distance")).first()
    assert got[0] == 500 and got[1] == pytest.approx(np.sort(dist(x, x), 1)[:, 4].sum())
