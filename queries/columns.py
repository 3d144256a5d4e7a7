"""Per-column tests: all of lineitem or customer, split by hash, under the shift grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import columns as C
from driftwell.operators import resample as S
from driftwell.operators.numbering import split_by_fraction
from driftwell.operators.views import in_subgroup
from driftwell.session import cut_lineage
from queries import query
from queries.common import as_output, table
from queries.resample import LINES_SQL, SUBGROUP, line_items, rank_sql, weights_sql

GRID = [0.0, 1.0]
RUNS = 2
SEED = 42
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAGS = ["l_returnflag", "l_linestatus"]


def sides(spark, sf):
    """(reference, pool, resamples joined with the pool) of lineitem with the share of returned items raised."""
    keyed = line_items(spark, sf).select("row_id", *NUMBERS, *FLAGS)
    rows = cut_lineage(split_by_fraction(keyed, "row_id", 0.5, seed=SEED))
    reference = rows.filter("is_reference").drop("is_reference")
    pool = rows.filter("NOT is_reference").drop("is_reference")
    counters = S.subgroup_shift_counters(pool, in_subgroup("l_returnflag", "R"), GRID, n_runs=RUNS, seed=SEED)
    return reference, pool, C.drawn_counters(pool, cut_lineage(counters), GRID, RUNS, [*NUMBERS, *FLAGS])


SPLIT_SQL = f"""{LINES_SQL}, split AS (SELECT *, k <= floor(0.5 * (SELECT count(*) FROM lines)) AS is_reference FROM {rank_sql("lines", "42", "split")}),
  ref AS (SELECT * FROM split WHERE is_reference), pool AS (SELECT * FROM split WHERE NOT is_reference),
  src AS (SELECT row_id, CASE WHEN l_returnflag = 'R' THEN 'b' ELSE 'a' END AS grp FROM pool),"""


def both_sql(columns: list[str], cast: str) -> str:
    """CTEs ending in ``counts(alpha, run, column, value, r, t)``."""
    ref = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::{cast} AS value, 1 AS n FROM ref" for c in columns)
    test = " UNION ALL ".join(
        f"SELECT alpha, run, '{c}' AS \"column\", {c}::{cast} AS value, w AS n FROM weights JOIN pool USING (row_id)" for c in columns
    )
    return f"""{weights_sql('src', SUBGROUP, ctes=SPLIT_SQL, alphas=GRID, runs=RUNS)},
    keys AS (SELECT DISTINCT alpha, run FROM weights),
    rc AS (SELECT "column", value, sum(n) AS n FROM ({ref}) GROUP BY 1, 2),
    tc AS (SELECT alpha, run, "column", value, sum(n) AS n FROM ({test}) GROUP BY 1, 2, 3, 4),
    counts AS (SELECT alpha, run, "column", value, sum(r)::DOUBLE AS r, sum(t)::DOUBLE AS t FROM
      (SELECT alpha, run, "column", value, n AS r, 0 AS t FROM rc, keys UNION ALL SELECT alpha, run, "column", value, 0, n FROM tc) GROUP BY 1, 2, 3, 4)"""


STEPS_SQL = f"""{both_sql(NUMBERS, 'DOUBLE')},
  steps AS (SELECT *, abs(sum(r) OVER w / sum(r) OVER g - sum(t) OVER w / sum(t) OVER g) AS gap, lead(value) OVER w - value AS width
    FROM counts WINDOW w AS (PARTITION BY alpha, run, "column" ORDER BY value), g AS (PARTITION BY alpha, run, "column"))"""

SHARES_SQL = f"""{both_sql(FLAGS, 'VARCHAR')},
  shares AS (SELECT *, sum(r) OVER g AS ra, sum(t) OVER g AS ta FROM counts WINDOW g AS (PARTITION BY alpha, run, "column"))"""

WASSERSTEIN_SQL = f"""WITH {STEPS_SQL},
  sd AS ({" UNION ALL ".join(f"SELECT '{c}' AS {chr(34)}column{chr(34)}, stddev_pop({c}) AS s FROM ref" for c in NUMBERS)}),
  wd AS (SELECT alpha, run, "column", sum(gap * width) / greatest(max(s), 1e-3) AS statistic FROM steps JOIN sd USING ("column") GROUP BY 1, 2, 3)"""

JS_EXPR = """sqrt(greatest(sum(((CASE WHEN r > 0 THEN r / ra * log2(r / ra / ((r / ra + t / ta) / 2)) ELSE 0 END)
    + (CASE WHEN t > 0 THEN t / ta * log2(t / ta / ((r / ra + t / ta) / 2)) ELSE 0 END)) / 2), 0))"""


@query(
    "ks_by_column",
    f'WITH {STEPS_SQL} SELECT alpha, run, "column", round(max(gap), 6) AS statistic FROM steps GROUP BY 1, 2, 3',
)
def ks_by_column(spark, sf):
    reference, pool, weights = sides(spark, sf)
    return as_output(C.ks_by_column(reference, pool, NUMBERS, weights).drop("p_value"))


@query(
    "ks_p_value",
    f"""WITH {STEPS_SQL}, d AS (SELECT alpha, run, "column", max(gap) AS d, sum(r) AS n, sum(t) AS m FROM steps GROUP BY 1, 2, 3),
    l AS (SELECT *, d * d * n * m / (n + m) AS lam2 FROM d)
    SELECT alpha, run, "column", round(CASE WHEN max(lam2) < 0.04 THEN 1 ELSE
      greatest(least(sum((CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0 * k * k * lam2)), 1), 0) END, 6) AS p_value
    FROM l, range(1, 101) t(k) GROUP BY 1, 2, 3""",
)
def ks_p_value(spark, sf):
    reference, pool, weights = sides(spark, sf)
    return as_output(C.ks_by_column(reference, pool, NUMBERS, weights).drop("statistic"))


@query("wasserstein_by_column", f'{WASSERSTEIN_SQL} SELECT alpha, run, "column", round(statistic, 6) AS statistic FROM wd')
def wasserstein_by_column(spark, sf):
    reference, pool, weights = sides(spark, sf)
    return as_output(C.wasserstein_by_column(reference, pool, NUMBERS, weights))


@query("js_by_column", f'WITH {SHARES_SQL} SELECT alpha, run, "column", round({JS_EXPR}, 6) AS statistic FROM shares GROUP BY 1, 2, 3')
def js_by_column(spark, sf):
    reference, pool, weights = sides(spark, sf)
    return as_output(C.jensen_shannon_by_column(reference, pool, FLAGS, weights))


@query(
    "chi_square_by_column",
    f"""WITH {SHARES_SQL} SELECT alpha, run, "column", round(sum((t - r / ra * ta) * (t - r / ra * ta) / (r / ra * ta)), 4) AS statistic,
    count(*) - 1 AS df FROM shares GROUP BY 1, 2, 3""",
)
def chi_square_by_column(spark, sf):
    reference, pool, weights = sides(spark, sf)
    return as_output(C.chi_square_by_column(reference, pool, FLAGS, weights).drop("p_value"), 4)


@query(
    "proportion_z_by_column",
    f"""WITH {SHARES_SQL}, f AS (SELECT alpha, run, "column", arg_min(r, value) AS r, arg_min(t, value) AS t, max(ra) AS n, max(ta) AS m, count(*) AS k
      FROM shares GROUP BY 1, 2, 3)
    SELECT alpha, run, "column", round((r / n - t / m) / sqrt((r + t) / (n + m) * (1 - (r + t) / (n + m)) * (1 / n + 1 / m)), 6) AS statistic
    FROM f WHERE k <= 2""",
)
def proportion_z_by_column(spark, sf):
    reference, pool, weights = sides(spark, sf)
    return as_output(C.proportion_z_by_column(reference, pool, FLAGS, weights).drop("p_value"))


#: The CTEs of SHARES_SQL after those of STEPS_SQL.
MORE_SHARES_SQL = SHARES_SQL[SHARES_SQL.index("    rc AS") :].replace("rc AS", "rc2 AS").replace("tc AS", "tc2 AS").replace("counts AS", "counts2 AS").replace("FROM rc,", "FROM rc2,").replace("FROM tc)", "FROM tc2)").replace("FROM counts ", "FROM counts2 ")

SHARE_SQL = (
    WASSERSTEIN_SQL
    + ", "
    + MORE_SHARES_SQL
    + f""", js AS (SELECT alpha, run, "column", {JS_EXPR} AS statistic FROM shares GROUP BY 1, 2, 3)
    SELECT alpha, run, round(avg((statistic >= 0.1)::INT::DOUBLE), 6) AS score FROM (SELECT * FROM wd UNION ALL SELECT * FROM js) GROUP BY 1, 2"""
)


CHI_P_SQL = """SELECT alpha, run, "column", exp(-sum((t - r / ra * ta) * (t - r / ra * ta) / (r / ra * ta)) / 2) AS p
  FROM shares WHERE "column" = 'l_returnflag' GROUP BY 1, 2, 3"""


@query("chi_square_p_value", f'WITH {SHARES_SQL}, ch AS ({CHI_P_SQL}) SELECT alpha, run, "column", round(p, 6) AS p_value FROM ch')
def chi_square_p_value(spark, sf):
    """The three return flags: two degrees of freedom, where the tail has a closed form."""
    reference, pool, weights = sides(spark, sf)
    found = C.chi_square_by_column(reference, pool, ["l_returnflag"], weights)
    return as_output(found.drop("statistic", "df"))


@query(
    "drifted_share_by_test",
    f"""WITH {STEPS_SQL}, {MORE_SHARES_SQL},
    d AS (SELECT alpha, run, "column", max(gap) AS d, sum(r) AS n, sum(t) AS m FROM steps GROUP BY 1, 2, 3),
    l AS (SELECT *, d * d * n * m / (n + m) AS lam2 FROM d),
    kp AS (SELECT alpha, run, "column", CASE WHEN max(lam2) < 0.04 THEN 1 ELSE
      sum((CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0 * k * k * lam2)) END AS p FROM l, range(1, 101) t(k) GROUP BY 1, 2, 3),
    ch AS ({CHI_P_SQL})
    SELECT alpha, run, round(avg((p < 0.05)::INT::DOUBLE), 6) AS score FROM (SELECT * FROM kp UNION ALL SELECT * FROM ch) GROUP BY 1, 2""",
)
def drifted_share_by_test(spark, sf):
    """The rule by p-values: Kolmogorov-Smirnov for numbers, chi-square for the flag."""
    reference, pool, weights = sides(spark, sf)
    return as_output(C.drifted_share(reference, pool, weights, columns=[*NUMBERS, "l_returnflag"], family="test"))


@query("drifted_share", SHARE_SQL)
def drifted_share(spark, sf):
    reference, pool, weights = sides(spark, sf)
    return as_output(C.drifted_share(reference, pool, weights))


@query(
    "two_table_drift",
    """WITH r AS (SELECT o_totalprice AS x FROM orders WHERE o_orderstatus = 'F'), t AS (SELECT o_totalprice AS x FROM orders WHERE o_orderstatus <> 'F'),
    c AS (SELECT x, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM (SELECT x, 1 AS a, 0 AS b FROM r UNION ALL SELECT x, 0, 1 FROM t) GROUP BY 1)
    SELECT 'o_totalprice' AS "column", round(max(abs(d)), 6) AS statistic
    FROM (SELECT sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER () AS d FROM c WINDOW w AS (ORDER BY x))""",
)
def two_table_drift(spark, sf):
    """Two plain tables without resampling: finished against other orders."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice", "o_orderstatus")
    done = orders.filter("o_orderstatus = 'F'").drop("o_orderstatus")
    rest = orders.filter("o_orderstatus <> 'F'").drop("o_orderstatus")
    return as_output(C.ks_by_column(done, rest, ["o_totalprice"]).select("column", "statistic"))
