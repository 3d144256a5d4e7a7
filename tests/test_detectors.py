"""Detectors against small numpy forms on materialised resamples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftwell.functions.distances import squared_distances
from driftwell.operators import kernel_tests as K
from driftwell.operators import neighbours, pairs
from driftwell.operators.neighbours import neighbour_kl_scores
from driftwell.operators.projected import distance_scores
from driftwell.operators.views import pca_views


def frame(spark, x):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "row_id bigint, v array<double>")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    ref, pool = rng.normal(size=(60, 4)), rng.normal(0.4, 1.1, size=(90, 4))
    pool[10] = pool[11]
    weights = {r: rng.multinomial(90, np.ones(90) / 90) for r in range(3)}
    rows = [(r, i, int(w)) for r, ws in weights.items() for i, w in enumerate(ws) if w]
    return {
        "ref": ref,
        "pool": pool,
        "w": weights,
        "ref_df": frame(spark, ref).cache(),
        "pool_df": frame(spark, pool).cache(),
        "w_df": spark.createDataFrame(rows, "run int, row_id bigint, w int").cache(),
    }


def dist(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


def test_squared_distances_keep_close_pairs_exact():
    x = np.array([[1e6, 2e6], [1e6, 2e6], [1e6 + 1e-3, 2e6]])
    d2 = squared_distances(x, x)
    assert d2[0, 1] == 0.0 and d2[0, 2] == pytest.approx((x[2, 0] - x[0, 0]) ** 2, rel=1e-12)


@pytest.mark.parametrize("share, block", [(True, 2048), (False, 2048), (False, 17)])
def test_distances_and_neighbours_over_blocks(data, share, block, monkeypatch):
    monkeypatch.setattr(pairs.PairPlan.__init__, "__kwdefaults__", {"share": None, "block_rows": block})
    d = dist(data["pool"], data["ref"])
    got = {r["row_id"]: r["mean_distance"] for r in pairs.mean_distances(data["pool_df"], data["ref_df"], share=share).collect()}
    assert [got[i] for i in range(90)] == pytest.approx(list(d.mean(1)), rel=1e-10)
    got = {r["row_id"]: r["kth_distance"] for r in pairs.nearest_distances(data["pool_df"], data["ref_df"], 5, share=share).collect()}
    assert [got[i] for i in range(90)] == pytest.approx(list(np.sort(d, 1)[:, 4]), rel=1e-10)


def kl_of(ref, test, k=5):
    rho = np.maximum(np.sort(dist(test, ref), 1)[:, k - 1], 1e-12)
    nu = np.maximum(np.sort(dist(test, test), 1)[:, k], 1e-12)
    return max(0.0, ref.shape[1] * np.mean(np.log(rho / nu)) + np.log(len(ref) / (len(test) - 1)))


@pytest.mark.parametrize("share, block", [(True, 2048), (False, 13)])
def test_kl_equals_the_materialised_resample(data, share, block, monkeypatch):
    monkeypatch.setattr(pairs.PairPlan.__init__, "__kwdefaults__", {"share": None, "block_rows": block})
    scored = neighbour_kl_scores(data["ref_df"], data["pool_df"], data["w_df"], share=share).collect()
    for r in scored:
        test = np.repeat(data["pool"], data["w"][r["run"]], axis=0)
        assert r["score"] == pytest.approx(kl_of(data["ref"], test), rel=1e-9)


def test_kl_with_one_row_drawn_very_often(spark, data):
    """A third of the resample is one row; its copies are its own nearest neighbours."""
    w = np.ones(90, dtype=int)
    w[3] = 45
    weights = spark.createDataFrame([(0, i, int(v)) for i, v in enumerate(w)], "run int, row_id bigint, w int")
    got = neighbour_kl_scores(data["ref_df"], data["pool_df"], weights).first()["score"]
    assert got == pytest.approx(kl_of(data["ref"], np.repeat(data["pool"], w, axis=0)), rel=1e-9)


@pytest.mark.parametrize("listed", [1, 8])
def test_lists_that_end_early_go_on_in_the_blocks(spark, data, listed, monkeypatch):
    """One resample takes every tenth row, one all its rows from two: short lists miss those."""
    monkeypatch.setattr(pairs.PairPlan.__init__, "__kwdefaults__", {"share": None, "block_rows": 13})
    monkeypatch.setattr(neighbours, "LISTED", listed)
    monkeypatch.setattr(neighbours, "WALK_ROWS", 7)
    drawn = [{i: 1 for i in range(90)}, {i: 1 for i in range(0, 90, 10)}, {4: 45, 77: 5}]
    weights = spark.createDataFrame(
        [(r, i, w) for r, rows in enumerate(drawn) for i, w in rows.items()], "run int, row_id bigint, w int"
    )
    got = neighbours.resampled_neighbour_distances(data["pool_df"], weights, 6, share=False).collect()
    assert len(got) == sum(map(len, drawn))
    d = dist(data["pool"], data["pool"])
    for r in got:
        copies = np.repeat(list(drawn[r["run"]]), list(drawn[r["run"]].values()))
        assert r["kth_distance"] == pytest.approx(np.sort(d[r["row_id"], copies])[5], rel=1e-9)


def test_rows_of_the_pair_stage_do_not_grow_with_resamples(data, monkeypatch):
    monkeypatch.setattr(pairs.PairPlan.__init__, "__kwdefaults__", {"share": None, "block_rows": 13})
    asked = []
    plain = neighbours.nearest_rows
    monkeypatch.setattr(neighbours, "nearest_rows", lambda *a, **b: asked.append(plain(*a, **b)) or asked[-1])
    for runs in (1, 3):
        weights = data["w_df"].filter(F.col("run") < runs).union(data["w_df"].filter(F.col("run") < runs).withColumn("run", F.col("run") + 9))
        neighbours.resampled_neighbour_distances(data["pool_df"], weights, 3, share=False).count()
    drawn = [np.count_nonzero(data["w"][0]), np.count_nonzero(sum(data["w"].values()))]
    assert [n.count() for n in asked] == [24 * n for n in drawn]


def test_kl_refuses_too_few_rows(data):
    with pytest.raises(ValueError, match="neighbours need"):
        neighbour_kl_scores(data["ref_df"], data["pool_df"], data["w_df"], n_neighbors=100)


def test_distance_score(data):
    within = dist(data["ref"], data["ref"]).mean()
    for r in distance_scores(data["ref_df"], data["pool_df"], data["w_df"], n_components=16).collect():
        test = np.repeat(data["pool"], data["w"][r["run"]], axis=0)
        assert r["score"] == pytest.approx(abs(dist(data["ref"], test).mean() - within), rel=1e-9)


def test_components_are_clamped_and_keep_distances(data):
    a, b = pca_views(data["ref_df"], data["pool_df"], 50)
    got = np.array([r["v"] for r in b.orderBy("row_id").collect()])
    assert got.shape[1] == 4
    assert dist(got, got) == pytest.approx(dist(data["pool"], data["pool"]), abs=1e-9)
    few, _ = pca_views(data["ref_df"], data["pool_df"], 2)
    centred = data["ref"] - data["ref"].mean(0)
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    got = np.array([r["v"] for r in few.orderBy("row_id").collect()])
    assert dist(got, got) == pytest.approx(dist(want, want), abs=1e-9)


@pytest.mark.parametrize("few", [200_000, 10])
def test_median_squared_distance(data, few, monkeypatch):
    monkeypatch.setattr(K, "FEW_PAIRS", few)
    monkeypatch.setattr(K, "HISTOGRAM_BINS", 16)
    d2 = dist(data["ref"], data["ref"])[np.triu_indices(60, 1)] ** 2
    assert K.median_squared_distance(data["ref_df"]) == pytest.approx(np.median(d2), rel=1e-9)


def mmd_of(x, y, median_d2):
    def k(a, b):
        return np.exp(-dist(a, b) ** 2 / median_d2)

    m, n = len(x), len(y)
    return (k(x, x).sum() - m) / (m * (m - 1)) + (k(y, y).sum() - n) / (n * (n - 1)) - 2 * k(x, y).mean()


@pytest.mark.parametrize("block", [1024, 19])
def test_mmd_statistic(data, block):
    got = K.mmd_statistics(data["ref_df"], data["pool_df"], data["w_df"], median_d2=3.0, block_rows=block).collect()
    assert len(got) == 3
    for r in got:
        test = np.repeat(data["pool"], data["w"][r["run"]], axis=0)
        assert r["mmd2"] == pytest.approx(mmd_of(data["ref"], test, 3.0), abs=1e-10)


@pytest.mark.parametrize("chunk", [2048, 7])
def test_relabelled_statistics(data, chunk, monkeypatch):
    """Each relabelling has the reference's size, and its statistic is that of its rows."""
    monkeypatch.setattr(K, "CHUNK_COLUMNS", chunk)
    counts = K.relabelled_counts(data["ref_df"], data["pool_df"], data["w_df"], 5).collect()
    stats = K.mmd_statistics(data["ref_df"], data["pool_df"], data["w_df"], n_permutations=5, median_d2=3.0, block_rows=40)
    got = {(r["run"], r["perm"]): r["mmd2"] for r in stats.collect()}
    assert len(got) == 3 * 6
    everything = np.concatenate([data["ref"], data["pool"]])
    place = {f"r:{i}": i for i in range(60)} | {f"t:{i}": 60 + i for i in range(90)}
    for run in range(3):
        total = np.concatenate([np.ones(60, dtype=int), data["w"][run]])
        for perm in range(5):
            u = np.zeros(150, dtype=int)
            for r in counts:
                if (r["run"], r["perm"]) == (run, perm):
                    u[place[r["row_id"]]] = r["n"]
            assert u.sum() == 60 and (u <= total).all()
            want = mmd_of(np.repeat(everything, u, axis=0), np.repeat(everything, total - u, axis=0), 3.0)
            assert got[run, perm] == pytest.approx(want, abs=1e-10)


def lsdd_of(x, y, centres, sigma2, ridge):
    def k(a):
        return np.exp(-dist(a, centres) ** 2 / (2 * sigma2)).mean(0)

    h = k(x) - k(y)
    big = np.exp(-dist(centres, centres) ** 2 / (4 * sigma2))
    theta = np.linalg.solve(big + ridge * np.eye(len(centres)), h)
    return 2 * theta @ h - theta @ big @ theta


def test_lsdd_statistic(data):
    from driftwell.operators.numbering import sample_rows

    ids = [r["row_id"] for r in sample_rows(data["ref_df"], "row_id", 20, seed=42, tag="centres").collect()]
    got = K.lsdd_statistics(
        data["ref_df"], data["pool_df"], data["w_df"], n_centres=20, n_permutations=3, median_d2=3.0, ridge=1e-2
    ).collect()
    assert len(got) == 3 * 4
    for r in got:
        if r["perm"] is None:
            test = np.repeat(data["pool"], data["w"][r["run"]], axis=0)
            assert r["lsdd"] == pytest.approx(lsdd_of(data["ref"], test, data["ref"][ids], 1.5, 1e-2), rel=1e-6)


def test_lsdd_bounds_its_centres(data):
    with pytest.raises(ValueError, match="centres"):
        K.lsdd_statistics(data["ref_df"], data["pool_df"], n_centres=1000)


@pytest.fixture(scope="module")
def gaussians(spark):
    rng = np.random.default_rng(42)
    shifts = (0.0, 0.0, 2.0)
    return [frame(spark, rng.normal(shift, 1, size=(100, 5))).cache() for shift in shifts]


@pytest.mark.parametrize(
    "score",
    [
        lambda ref, p: K.mmd_scores(ref, p, n_permutations=20),
        lambda ref, p: K.lsdd_scores(ref, p, n_permutations=20),
        neighbour_kl_scores,
        distance_scores,
    ],
)
def test_shifted_rows_score_higher(gaussians, score):
    ref, same, moved = gaussians
    low, high = score(ref, same).first()["score"], score(ref, moved).first()["score"]
    assert high > low >= 0


def test_scores_are_shares_of_relabellings(data):
    rows = K.mmd_scores(data["ref_df"], data["pool_df"], data["w_df"], n_permutations=10).collect()
    for r in rows:
        assert r["score"] == pytest.approx(1 - r["p_value"]) and (r["p_value"] * 10) % 1 == pytest.approx(0, abs=1e-9)


def test_no_vector_is_lost_without_weights(data):
    assert pairs.mean_distances(data["pool_df"], data["ref_df"]).agg(F.count("*")).first()[0] == 90


def test_grid_covers_every_pair_once(spark):
    """Groups of several blocks: every ordered pair of rows counts once, and a row is copied once per group."""
    df = frame(spark, np.arange(50.0)[:, None])

    def kernel(x, y, times):
        same = (x.x[:, 0][:, None] == y.x[:, 0][None]).sum()
        return pa.table({"pairs": [times * len(x.x) * len(y.x)], "same": [int(same)]})

    got = pairs.self_pairs(df, 50, kernel, "pairs bigint, same bigint", block_rows=3).agg(F.sum("pairs"), F.sum("same")).first()
    assert tuple(got) == (2500, 50)
    left, right = pairs.triangle(df, 4)
    assert left.count() + right.count() == 4 * 50
    assert [pairs.grid_groups(b, 8) for b in (1, 2, 9, 100, 10_000)] == [1, 2, 3, 10, 100]
