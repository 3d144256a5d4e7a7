"""Equal vectors meet as one: the results are those of the rows."""

from __future__ import annotations

import numpy as np
import pytest

from driftwell.functions.distances import nearest
from driftwell.operators import pairs
from driftwell.operators.neighbours import neighbour_kl_scores
from driftwell.operators.projected import distance_scores


def dist(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


@pytest.fixture(scope="module")
def copied(spark):
    """60 rows with 12 different vectors, the first one on 30 of them, and resamples of the rows."""
    rng = np.random.default_rng(11)
    different = rng.normal(size=(12, 3))
    x = different[np.concatenate([np.zeros(30, int), np.arange(30) % 12])]
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id bigint, v array<double>").cache()
    drawn = [(r, i, int(w)) for r in range(2) for i, w in enumerate(rng.multinomial(60, np.ones(60) / 60)) if w]
    return x, rows, spark.createDataFrame(drawn, "run int, row_id bigint, w int").cache()


@pytest.mark.parametrize("share", [None, False])
def test_distances_of_copies(copied, share, monkeypatch):
    x, rows, _ = copied
    monkeypatch.setattr(pairs, "DIFFERENT_ROWS", 10)
    assert pairs.different_vectors(rows).count() == 12
    d = dist(x, x)
    got = {r["row_id"]: r["mean_distance"] for r in pairs.mean_distances(rows, rows, share=share).collect()}
    assert [got[i] for i in range(60)] == pytest.approx(list(d.mean(1)), rel=1e-10)
    for index in (False, True):
        got = {r["row_id"]: r["kth_distance"] for r in pairs.nearest_distances(rows, rows, 7, share=share, index=index).collect()}
        assert [got[i] for i in range(60)] == pytest.approx(list(np.sort(d, 1)[:, 6]), abs=1e-10)
    assert pairs.mean_pair_distance(rows) == pytest.approx(d.mean(), rel=1e-10)


def test_repeated_keys_keep_their_rows(spark):
    """Different vectors under one key: the index counts each right row once."""
    x = [(0, 0.0), (0, 1.0), (1, 3.0), (2, 6.0), (2, 6.5)]
    rows = spark.createDataFrame([(i, [v]) for i, v in x], "row_id bigint, v array<double>")
    asked = spark.createDataFrame([(9, [0.0])], "row_id bigint, v array<double>")
    got = [r["kth_distance"] for r in pairs.nearest_distances(asked, rows, 4, share=False, index=True).collect()]
    assert got == [6.0]


def test_scores_of_copies(copied, monkeypatch):
    _, rows, weights = copied
    reference = rows.filter("row_id >= 28")
    scores = [lambda: distance_scores(reference, rows, weights, n_components=None), lambda: neighbour_kl_scores(reference, rows, weights)]
    plain = [{r["run"]: r["score"] for r in s().collect()} for s in scores]
    monkeypatch.setattr(pairs, "DIFFERENT_ROWS", 10)
    merged, _ = pairs.merged_rows(rows, weights)
    assert merged.count() == 12
    for score, expected in zip(scores, plain, strict=True):
        assert {r["run"]: r["score"] for r in score().collect()} == pytest.approx(expected, abs=1e-9)


def test_nearest_over_several_tiles():
    rng = np.random.default_rng(12)
    a, b = rng.normal(size=(150, 2)), rng.normal(size=(5000, 2))
    b[3000:3100] = a[0]
    at, d = nearest(a, b, 20)
    full = dist(a, b)
    assert d == pytest.approx(np.sort(full, 1)[:, :20], abs=1e-10)
    assert np.take_along_axis(full, at, 1) == pytest.approx(d, abs=1e-10) and all(len(set(p)) == 20 for p in at)
