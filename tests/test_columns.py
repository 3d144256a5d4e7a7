from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.functions.stats import _chi_square_tail, kolmogorov_p
from driftwell.operators import columns as C


def numbers(spark, x, name="x"):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], f"row_id bigint, {name} double")


def strings(spark, x):
    return spark.createDataFrame(list(enumerate(x)), "row_id bigint, c string")


def test_chi_square_tail_known_values():
    assert _chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert _chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-10)
    assert _chi_square_tail(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-10)
    assert _chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert _chi_square_tail(math.inf, 3) == 0.0 and _chi_square_tail(0.0, 3) == 1.0


def test_kolmogorov_known_value(spark):
    # the 5 % point of the limit distribution is 1.3581
    got = spark.range(1).select(kolmogorov_p(F.lit(1.3581015), F.lit(2), F.lit(2)).alias("p")).first()["p"]
    assert got == pytest.approx(0.05, abs=1e-5)


def test_ks_and_wasserstein_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=300), np.full(150, 0.5)])
    y = np.concatenate([rng.normal(0.3, 2, size=200), np.full(100, 0.5)])
    got = C.numeric_statistics(numbers(spark, x), numbers(spark, y), ["x"]).first()
    grid = np.unique(np.concatenate([x, y]))
    f = np.searchsorted(np.sort(x), grid, "right") / len(x)
    g = np.searchsorted(np.sort(y), grid, "right") / len(y)
    assert got["ks"] == pytest.approx(np.abs(f - g).max(), abs=1e-12)
    assert got["wasserstein"] == pytest.approx((np.abs(f - g)[:-1] * np.diff(grid)).sum() / x.std(), rel=1e-9)


def test_more_resamples_than_slots_equal_materialised_rows(spark):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 40, 200), rng.integers(5, 45, 120)
    ws = {r: rng.multinomial(120, np.ones(120) / 120) for r in range(2 * C.SLOTS + 3)}
    weights = spark.createDataFrame(
        [(r, i, int(v)) for r, w in ws.items() for i, v in enumerate(w) if v], "run int, row_id bigint, w int"
    )
    got = {r["run"]: r for r in C.numeric_statistics(numbers(spark, x), numbers(spark, y), ["x"], weights).collect()}
    assert len(got) == len(ws)
    grid = np.arange(0, 50)
    f = np.searchsorted(np.sort(x), grid, "right") / len(x)
    for r, w in ws.items():
        t = np.sort(np.repeat(y, w))
        g = np.searchsorted(t, grid, "right") / len(t)
        assert got[r]["ks"] == pytest.approx(np.abs(f - g).max(), abs=1e-12)
        assert got[r]["wasserstein"] == pytest.approx(np.abs(f - g)[:-1].sum() / x.std(), rel=1e-9)


def test_categories_against_direct_formulas(spark):
    ref, test = ["a"] * 50 + ["b"] * 30 + ["c"] * 20, ["a"] * 20 + ["b"] * 25 + ["c"] * 35
    got = C.categorical_statistics(strings(spark, ref), strings(spark, test), ["c"]).first()
    p, q = np.array([0.5, 0.3, 0.2]), np.array([20, 25, 35]) / 80
    mid = (p + q) / 2
    assert got["js"] == pytest.approx(np.sqrt((p * np.log2(p / mid) + q * np.log2(q / mid)).sum() / 2), rel=1e-12)
    assert got["chi_square"] == pytest.approx((((80 * q) - 80 * p) ** 2 / (80 * p)).sum(), rel=1e-12)
    assert got["df"] == 2 and got["z"] is None


def test_two_categories_give_z(spark):
    got = C.proportion_z_by_column(strings(spark, ["a"] * 40 + ["b"] * 60), strings(spark, ["a"] * 30 + ["b"] * 20), ["c"]).first()
    pooled = 70 / 150
    z = (0.4 - 0.6) / math.sqrt(pooled * (1 - pooled) * (1 / 100 + 1 / 50))
    assert got["statistic"] == pytest.approx(z, rel=1e-12)
    assert got["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-12)


def test_category_unseen_in_the_reference_is_drift(spark):
    got = C.chi_square_by_column(strings(spark, ["a"] * 5 + ["b"] * 5), strings(spark, ["a"] * 5 + ["new"] * 5), ["c"]).first()
    assert math.isinf(got["statistic"]) and got["p_value"] == 0.0


def mixed(spark, seed, n, shift=0.0):
    rng = np.random.default_rng(seed)
    rows = [
        (i, float(rng.normal(shift)), float(rng.normal()), int(rng.integers(0, 3)), "xyz"[rng.integers(0, 3)], "uv"[int(rng.random() < 0.5)])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "row_id bigint, a double, b double, few int, c string, two string")


@pytest.mark.parametrize("family, tests", [("test", {"a": "ks", "b": "ks", "few": "chi_square", "c": "chi_square", "two": "z"}),
                                          ("distance", {"a": "wasserstein", "b": "wasserstein", "few": "jensen_shannon", "c": "jensen_shannon", "two": "jensen_shannon"})])
def test_choice_of_tests_and_share(spark, family, tests):
    ref, moved = mixed(spark, 1, 300), mixed(spark, 2, 300, shift=1.5)
    rows = {r["column"]: r for r in C.column_drift(ref, moved, family=family).collect()}
    assert {c: r["test"] for c, r in rows.items()} == tests
    assert rows["a"]["drifted"]
    share = C.drifted_share(ref, moved, family=family).first()["score"]
    assert share == pytest.approx(sum(r["drifted"] for r in rows.values()) / 5)


def test_same_table_has_no_drift(spark):
    ref = mixed(spark, 3, 200)
    assert C.drifted_share(ref, ref).first()["score"] == 0.0


def test_unknown_family_is_refused(spark):
    ref = mixed(spark, 3, 20)
    with pytest.raises(ValueError, match="family"):
        C.column_drift(ref, ref, family="auto")


def test_wide_tables_are_melted_and_sketched_without_a_struct_or_aggregate_per_column(spark):
    rows = [(i, *(float(i * k % (k + 1)) if k % 7 else None for k in range(80)), "ab"[i % 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id bigint, " + ", ".join(f"f{k} double" for k in range(80)) + ", s string")
    columns = df.columns[1:]
    plan = C.melted(df, columns, "string")._jdf.queryExecution().optimizedPlan().toString()
    assert "struct" not in plan and "posexplode" in plan
    found = C._distinct_values(df, columns)
    wanted = {c: len({r[i + 1] for r in rows} - {None}) for i, c in enumerate(columns)}
    assert {c: k for c, k in found.items() if wanted[c] <= 40} == {c: k for c, k in wanted.items() if k <= 40}
    assert all(found[c] > C.FEW_VALUES for c, k in wanted.items() if k > 40)
    got = sorted((r["column"], r["value"]) for r in C.melted(df.limit(3), ["f1", "f7", "s"], "string").collect())
    assert got == [("f1", "0.0"), ("f1", "0.0"), ("f1", "1.0"), ("s", "a"), ("s", "a"), ("s", "b")]
