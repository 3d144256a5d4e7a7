from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import views as V
from driftwell.plans import domains, registry, runs
from driftwell.plans.commits import CommitConflict, CommitLog
from driftwell.session import ensure_checkpoint_dir
from driftwell.sources import delimited, results
from driftwell.sources.text import tfidf_vectors


@pytest.fixture(scope="module")
def domain(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal(3 * (i % 5 == 0))), float(rng.normal()), "in" if i % 5 == 0 else "out", "yes") for i in range(300)]
    table = spark.createDataFrame(rows, "id bigint, x double, y double, part string, income string").cache()
    return domains.create_domain(
        "table", table=table, row_id="id", subgroup_column="part", subgroup_value="in", label="income", surplus=1
    )


def as_dict(metrics):
    """Metric values by (detector, alpha), comparable up to the order of float sums."""
    rows = metrics.collect()
    return {
        (r["detector"], float(r["alpha"])): tuple(None if v is None else pytest.approx(v, rel=1e-9) for v in tuple(r)[2:])
        for r in rows
    }


def values(metrics):
    return {(r["detector"], float(r["alpha"])): tuple(r)[2:] for r in metrics.collect()}


def test_label_is_dropped_and_split_is_half(domain):
    reference, pool = domain.columns
    assert reference.count() == pool.count() == 150
    assert "income" not in reference.columns
    assert len(domain.numeric[0].first()["v"]) == 4


def test_resumed_run_equals_an_uninterrupted_one(spark, domain, tmp_path):
    options = {"n_runs": 3, "detectors": ["distance", "kl"], "alphas_per_save": 9}
    whole = runs.run_domain(domain, runs.Store(spark, f"{tmp_path}/a"), alphas=[0.0, 0.005, 0.5], **options)
    store = runs.Store(spark, f"{tmp_path}/b")
    runs.run_domain(domain, store, alphas=[0.0], **options)
    before = store.scores().filter("alpha = 0").orderBy("detector", "run").collect()
    resumed = runs.run_domain(domain, store, alphas=[0.0, 0.005, 0.5], **options)
    assert values(whole) == as_dict(resumed)
    assert store.scores().filter("alpha = 0").orderBy("detector", "run").collect() == before
    assert runs.pending_work(runs.plan_work(spark, ["distance", "kl"], [0.0, 0.005, 0.5], 3), store.scores()).count() == 0
    # final metrics exist: nothing to do unless forced
    assert runs.run_if_needed(domain, store, alphas=[0.0, 1.0], **options) is None


def test_forced_run_keeps_the_other_detectors(spark, domain, tmp_path):
    store = runs.Store(spark, f"{tmp_path}/c")
    runs.run_domain(domain, store, alphas=[0.0, 1.0], n_runs=3, detectors=["distance", "columns"], alphas_per_save=9)
    old = {(r["detector"], r["run"]): r["score"] for r in store.calibration().collect()}
    metrics = runs.run_if_needed(domain, store, alphas=[0.0, 1.0], n_runs=3, detectors=["distance"], seed=7, force=True, alphas_per_save=9)
    assert {k[0] for k in values(metrics)} == {"distance", "columns"}
    new = {(r["detector"], r["run"]): r["score"] for r in store.calibration().collect()}
    assert all(new[k] == old[k] for k in old if k[0] == "columns")
    assert any(new[k] != old[k] for k in old if k[0] == "distance")


def test_other_setup_is_not_mixed_in(spark, domain, tmp_path):
    """Held-out draws begin after the last run, so another number of runs starts anew."""
    options = {"alphas": [0.0, 0.5], "detectors": ["distance"], "alphas_per_save": 9}
    fresh = values(runs.run_domain(domain, runs.Store(spark, f"{tmp_path}/e"), n_runs=4, seed=1, **options))
    store = runs.Store(spark, f"{tmp_path}/f")
    runs.run_domain(domain, store, n_runs=2, seed=1, alphas=[0.0, 0.5, 1.0], detectors=["distance"], alphas_per_save=9)
    again = runs.run_domain(domain, store, n_runs=4, seed=1, **options)
    assert fresh == as_dict(again)  # the old intensity 1.0 has another setup
    assert store.scores({"distance": runs.run_setup("distance", 4, 2)}).count() == 0


def test_scores_are_saved_after_each_intensity(spark, domain, tmp_path):
    """A detector that fails at the second intensity leaves the first one and its partial metrics."""
    calls = []

    @registry.register_detector("breaks")
    def breaks(domain, weights):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return weights.groupBy("phase", "alpha", "run").agg(F.count("*").cast("double").alias("score"))

    store = runs.Store(spark, f"{tmp_path}/g")
    options = {"alphas": [0.0, 0.5], "n_runs": 2, "detectors": ["breaks"]}
    try:
        with pytest.raises(RuntimeError, match="stopped"):
            runs.run_domain(domain, store, **options)
        assert {float(r["alpha"]) for r in store.scores().collect()} == {0.0}
        assert spark.read.option("header", True).csv(store.partial_path).count() == 1
    finally:
        del registry._DETECTORS["breaks"]


def test_a_step_shows_whole_or_not_at_all(spark, domain, tmp_path, monkeypatch):
    """Stopped after the data of a step are written and before its commit."""
    options = {"alphas": [0.0, 0.5], "n_runs": 2, "detectors": ["distance"]}
    whole = values(runs.run_domain(domain, runs.Store(spark, f"{tmp_path}/whole"), **options))
    store = runs.Store(spark, f"{tmp_path}/cut")
    commit, calls = CommitLog.commit, []

    def stops(self, content, after):
        calls.append(after)
        if len(calls) in (1, 3):
            raise RuntimeError("stopped")
        return commit(self, content, after)

    monkeypatch.setattr(CommitLog, "commit", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        runs.run_domain(domain, store, **options)
    assert list((tmp_path / "cut" / "data").iterdir())  # written, but part of nothing
    assert store.scores().count() == store.calibration().count() == 0
    with pytest.raises(RuntimeError, match="stopped"):
        runs.run_domain(domain, store, **options)
    assert [float(a) for a, in store.scores().select("alpha").distinct().collect()] == [0.0]
    assert store.calibration().count() == 2 and not store.has_metrics()
    monkeypatch.setattr(CommitLog, "commit", commit)
    assert whole == as_dict(runs.run_domain(domain, store, **options)) and store.has_metrics()
    named = str(store.log.newest()[1])
    assert {p.name for p in (tmp_path / "cut" / "data").iterdir()} == {f.name for f in (tmp_path / "cut" / "data").iterdir() if f.name in named}
    assert len(list((tmp_path / "cut" / "commits").glob("*.draft"))) == 0
    assert not list(Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob("scratch-*"))


def test_commits_of_two_runs_do_not_mix(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    assert log.newest() == (0, {})
    assert log.commit({"a": "data/x"}, 0) == 1
    with pytest.raises(CommitConflict):
        log.commit({"a": "data/y"}, 0)
    for name in ("x", "y"):
        spark.range(1).write.parquet(f"{tmp_path}/log/data/{name}")
    log.sweep()
    assert log.newest() == (1, {"a": "data/x"}) and log.exists("data/x") and not log.exists("data/y")


def test_unshifted_and_fully_shifted(spark, domain, tmp_path):
    metrics = runs.run_domain(domain, runs.Store(spark, f"{tmp_path}/d"), alphas=[0.0, 1.0], n_runs=5, detectors=["distance"], alphas_per_save=9)
    rows = values(metrics)
    assert rows["distance", 1.0][0] == 1.0


def test_registry():
    assert set(registry.available_detectors()) >= {"mmd", "lsdd", "kl", "distance", "columns"}
    with pytest.raises(ValueError, match="Unknown detector"):
        registry.get_detector("nope")
    with pytest.raises(TypeError):
        registry.get_detector("kl", kernel="rbf")
    registry.detector_from_settings("kl", {"n_neighbors": 3, "kernel": "rbf"})
    assert registry.enabled_detectors({"mmd": {"enabled": False}, "kl": {}}) == ["kl"]
    assert registry.enabled_detectors(None) == registry.available_detectors()


def test_own_detector(spark, domain):
    @registry.register_detector("rows")
    def rows(domain, weights):
        return weights.groupBy("phase", "alpha", "run").agg(F.count("*").cast("double").alias("score"))

    try:
        weights = domains.draw_grid(domain, [0.0, 1.0], 2)
        assert runs.score_grid(domain, weights, ["rows"]).count() == 2 * 2 + 2
    finally:
        del registry._DETECTORS["rows"]


def test_unknown_domain():
    with pytest.raises(ValueError, match="Unsupported domain"):
        domains.create_domain("nope")
    assert set(domains.available_domains()) == {"table", "vectors", "series", "text"}


def test_census_scan(spark, tmp_path):
    line = "39, State-gov , 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, White, Male, 2174, 0, 40, United-States, <=50K"
    (tmp_path / "rows.data").write_text(f"{line}\n\n{line.replace('Adm-clerical', '?')}\n{line.replace('White', '')}\n")
    rows = delimited.read_census(spark, str(tmp_path / "rows.data")).collect()
    assert len(rows) == 1
    assert (rows[0]["age"], rows[0]["workclass"], rows[0]["income"]) == (39.0, "State-gov", "<=50K")


def test_scores_json(spark, tmp_path):
    (tmp_path / "s.json").write_text('{\n "d": {"0.0": [0.1, 0.2], "0.005": [0.5]},\n "e": {"1.0": [1]}\n}\n')
    rows = {(r["detector"], float(r["alpha"]), r["run"]): r["score"] for r in results.read_scores_json(spark, str(tmp_path / "s.json")).collect()}
    assert rows == {("d", 0.0, 0): 0.1, ("d", 0.0, 1): 0.2, ("d", 0.005, 0): 0.5, ("e", 1.0, 0): 1.0}
    (tmp_path / "c.json").write_text('{"d": [0.3, 0.4]}')
    rows = results.read_calibration_json(spark, str(tmp_path / "c.json")).orderBy("run").collect()
    assert [tuple(r) for r in rows] == [("d", 0, 0.3), ("d", 1, 0.4)]
    (tmp_path / "bad.json").write_text('{"d": [0.3,\n')
    for read in (results.read_scores_json, results.read_calibration_json):
        with pytest.raises(Exception, match="not a score document"):
            read(spark, str(tmp_path / "bad.json")).collect()


def test_missing_result_folder(spark, tmp_path):
    with pytest.raises(ValueError, match="no metrics"):
        results.read_domain_metrics(spark, {"x": f"{tmp_path}/none"})


def test_one_hot_unknown_category_is_zero(spark):
    rows = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "zzz"), (3, 4.0, None)], "id bigint, n double, c string")
    got = {r["row_id"]: r["v"] for r in V.one_hot(rows, "id", ["n"], {"c": ["a", "b"]}).collect()}
    assert got == {1: [2.0, 1.0, 0.0], 2: [3.0, 0.0, 0.0], 3: [4.0, 0.0, 0.0]}


def test_tfidf_of_empty_and_known_documents(spark):
    docs = spark.createDataFrame([(1, "Rain rain wind"), (2, "wind"), (3, "the and I")], "row_id bigint, text string")
    got = {r["row_id"]: r["v"] for r in tfidf_vectors(docs, docs).collect()}
    rain, wind = 2 * (np.log(4 / 2) + 1), np.log(4 / 3) + 1
    norm = np.hypot(rain, wind)
    assert got[1] == pytest.approx([rain / norm, wind / norm], rel=1e-6)
    assert got[2] == [0.0, 1.0] and got[3] == [0.0, 0.0]


def test_checkpoint_folder_comes_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir") in ensure_checkpoint_dir(spark)
