"""Sums of distances through stand-ins of far cells: the results are those of all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from driftwell.functions import far_sums as cells
from driftwell.functions.distances import distance_sums
from driftwell.operators import far_pairs, pairs
from driftwell.operators.projected import distance_scores
from driftwell.plans.domains import create_domain
from driftwell.plans.runs import Store, run_domain


def accounts(n, seed=3):
    """Balances, a country and a two-way flag, every tenth row the same vector."""
    rng = np.random.default_rng(seed)
    flag = rng.integers(0, 2, n)
    x = np.column_stack([np.round(rng.uniform(-999, 9999, n), 2), rng.integers(0, 4, n), flag, 1 - flag])
    x[::10] = x[0]
    return x


@pytest.fixture(scope="module")
def table(spark):
    x = accounts(6000)
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id bigint, v array<double>").cache()


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(far_pairs, "FAR_PAIRS", 1 << 10)
    monkeypatch.setattr(far_pairs, "LEAF_ROWS", 128)


def expected(x, y):
    return distance_sums(x, y, np.ones(len(y))) / len(y)


def test_stand_ins_keep_the_sums_of_all_directions():
    rng = np.random.default_rng(4)
    x, n = rng.normal(size=(500, 3)), rng.integers(1, 5, 500).astype(float)
    centre, radius = np.zeros(3), float(np.sqrt((x**2).sum(1).max()))
    kept, weights = cells.stand_in(x, n, centre, radius, 1e-12 * 100)
    assert len(kept) <= 192 and weights.sum() == pytest.approx(n.sum(), rel=1e-9)
    for far in (1.0, 4.0, 300.0):
        u = rng.normal(size=(200, 3))
        at = u / np.linalg.norm(u, axis=1)[:, None] * radius * (1 + cells.REACH * far)
        assert distance_sums(at, kept, weights) == pytest.approx(distance_sums(at, x, n), rel=1e-11)


def test_rows_without_structure_have_no_stand_in():
    x = np.random.default_rng(5).normal(size=(200, 16))
    assert cells.stand_in(x, np.ones(200), np.zeros(16), float(np.sqrt((x**2).sum(1).max())), 1e-12) is None


def test_every_row_is_met_once():
    """Near leaves and far cells of a target make up the whole table, whatever stand-ins there are."""
    x = accounts(4000)
    tree = cells.Tree.of(x[::5], 5)
    leaf = tree.leaves(x)
    rows = [np.flatnonzero(leaf == i) for i in range(32)]
    low = [cells.leaf_cell(x[r], np.ones(len(r)), 1e-8) if len(r) else None for r in rows]
    levels = [low, *cells.joined_levels(low, 1e-8, 5)]
    below = [{i} for i in range(32)]
    covers = list(below)
    for _ in range(5):
        below = [below[i] | below[i + 1] for i in range(0, len(below), 2)]
        covers += below
    there = [c is not None for c in low]
    far, near = cells.meetings(levels, np.array([c.centre if c else np.zeros(4) for c in low]), np.array([c.radius if c else -1.0 for c in low]))
    for t in np.flatnonzero(there):
        met = [i for c in far[t] for i in covers[c] if there[i]] + list(near[t])
        assert sorted(met) == list(np.flatnonzero(there))
    assert max(len(n) for n in near) < 32


def test_mean_distances_of_many_rows(table, small_leaves, monkeypatch):
    x, rows = table
    found = far_pairs.far_sums(rows, rows.selectExpr("row_id", "v", "1L AS n"), n_left=6000, n_right=6000)
    assert found is not None  # not all pairs
    monkeypatch.setattr(pairs.PairPlan, "run", None)
    got = {r["row_id"]: r["mean_distance"] for r in pairs.mean_distances(rows, rows).collect()}
    assert [got[i] for i in range(6000)] == pytest.approx(list(expected(x, x)), rel=1e-11)
    monkeypatch.setattr(pairs, "self_pairs", None)
    assert pairs.mean_pair_distance(rows) == pytest.approx(expected(x, x).mean(), rel=1e-11)


def test_targets_of_their_own(spark, table, small_leaves):
    """Targets far outside of the table, and one whose coordinates are not all numbers, which has no mean."""
    x, rows = table
    asked = np.vstack([accounts(300, seed=8), [[1e6, 0, 0, 0], [-5e5, 1e5, 0, 1], [np.nan, 1, 0, 1]]])
    left = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(asked)], "row_id bigint, v array<double>")
    assert far_pairs.far_sums(left, rows.selectExpr("row_id", "v", "1L AS n"), n_left=303, n_right=6000) is not None
    got = {r["row_id"]: r["mean_distance"] for r in pairs.mean_distances(left, rows).collect()}
    assert [got[i] for i in range(302)] == pytest.approx(list(expected(asked[:302], x)), rel=1e-11)
    assert got[302] is None or np.isnan(got[302])


def test_all_pairs_where_there_is_nothing_to_gain(spark, small_leaves):
    x = np.random.default_rng(9).normal(size=(700, 12))
    frame = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "row_id bigint, v array<double>, n bigint")
    assert far_pairs.far_sums(frame, frame, n_left=700, n_right=700) is None
    odd = frame.selectExpr("row_id", "IF(row_id = 3, array_repeat(CAST('NaN' AS double), 12), v) AS v", "n")
    assert far_pairs.far_sums(frame, odd, n_left=700, n_right=700) is None
    got = {r["row_id"]: r["mean_distance"] for r in pairs.mean_distances(frame, frame, share=False).collect()}
    assert [got[i] for i in range(700)] == pytest.approx(list(expected(x, x)), rel=1e-11)


def test_distance_scores_of_many_rows(table, small_leaves, spark, monkeypatch):
    """Both means of the distance detector, under weights, without a meeting of all pairs."""
    x, rows = table
    rng = np.random.default_rng(6)
    reference, w = rows.filter("row_id < 5000"), rng.integers(0, 3, 6000)
    weights = spark.createDataFrame([(0, i, int(n)) for i, n in enumerate(w) if n], "run int, row_id bigint, w int")
    monkeypatch.setattr(pairs.PairPlan, "run", None)
    monkeypatch.setattr(pairs, "self_pairs", None)
    got = {r["run"]: r["score"] for r in distance_scores(reference, rows, weights, n_components=16).collect()}
    crossing = (expected(x, x[:5000]) * w).sum() / w.sum()
    assert got[0] == pytest.approx(abs(crossing - expected(x[:5000], x[:5000]).mean()), abs=1e-7)


def test_resumed_run_of_many_rows(spark, small_leaves, tmp_path, monkeypatch):
    """A stopped and resumed run scores what one detector call does, without a meeting of all pairs."""
    monkeypatch.setattr(far_pairs, "WORTH", 1.0)
    x = accounts(9400, seed=7)
    frame = spark.createDataFrame(
        [(i, float(v[0]), float(v[1]), "in" if v[2] else "out") for i, v in enumerate(x)], "k bigint, balance double, nation double, seg string"
    ).cache()
    domain = create_domain("table", table=frame, row_id="k", subgroup_column="seg", subgroup_value="in")
    with monkeypatch.context() as patched:
        patched.setattr(far_pairs, "FAR_PAIRS", 1 << 60)
        plain = distance_scores(*domain.numeric, domain.draw([0.0, 1.0], 2, 42))
        before = {(float(r["alpha"]), r["run"]): r["score"] for r in plain.collect()}
    monkeypatch.setattr(pairs.PairPlan, "run", None)
    monkeypatch.setattr(pairs, "self_pairs", None)
    store = Store(spark, str(tmp_path / "run"))
    for alphas in ([0.0], [0.0, 1.0]):
        run_domain(domain, store, alphas=alphas, n_runs=2, detectors=["distance"])
    got = {(float(r["alpha"]), r["run"]): r["score"] for r in store.scores().collect()}
    assert got == pytest.approx(before, abs=1e-7)
