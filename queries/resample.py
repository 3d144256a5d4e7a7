"""Numbering, splitting, sampling and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import numbering as N
from driftwell.operators import resample as S
from driftwell.operators.views import in_subgroup
from queries import query
from queries.common import as_output, draw_sql, table

GRID = [0.0, 0.25, 0.5, 1.0]
RUNS = 3
SEED = 42

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_ID_SQL = "md5(concat_ws(':', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR, round(l_extendedprice * 100)::BIGINT::VARCHAR))"


def line_items(spark, sf):
    """lineitem with a unique key."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    key = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in LINE_KEY], cents))
    return table(spark, sf, "lineitem").withColumn("row_id", key)


LINES_SQL = f"lines AS (SELECT *, {LINE_ID_SQL} AS row_id FROM lineitem)"


def rank_sql(source: str, seed: str, tag: str, row_id: str = "row_id", partition: str = "") -> str:
    by = f"PARTITION BY {partition} " if partition else ""
    return f"(SELECT *, row_number() OVER ({by}ORDER BY md5('{seed}:{tag}:' || {row_id}::VARCHAR), {row_id}) AS k FROM {source})"


def numbered_sql(source: str) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('rows:' || row_id::VARCHAR), row_id) - 1 AS rn,
      count(*) OVER (PARTITION BY grp) AS size FROM {source})"""


def weights_sql(source: str, counts: str, *, runs: int = RUNS, seed: int = SEED, alphas: list[float] | None = None, ctes: str = "") -> str:
    """CTEs ending in ``weights(alpha, run, row_id, w)``; ``source`` has (row_id, grp) and
    ``counts`` is the SQL number of rows taken from group b at ``alpha``."""
    grid = ", ".join(f"({a}::DOUBLE)" for a in (alphas or GRID))
    return f"""{ctes}
    numbered AS {numbered_sql(source)},
    sizes AS (SELECT count(*) AS n, count(*) FILTER (grp = 'b') AS nb FROM {source}),
    grid AS (SELECT alpha, round_even({counts}, 0)::BIGINT AS kb, n FROM (VALUES {grid}) t(alpha), sizes),
    quota AS (SELECT alpha, 'b' AS grp, kb AS q FROM grid UNION ALL SELECT alpha, 'a', n - kb FROM grid),
    groups AS (SELECT DISTINCT grp, size FROM numbered WHERE grp IN ('a', 'b')),
    draws AS (SELECT run, grp, draw, {draw_sql("size", f"run + {seed}", "grp", "draw")} AS rn
      FROM groups, range({runs}) r(run), range((SELECT n FROM sizes)) d(draw)),
    weights AS (SELECT alpha, run::INT AS run, row_id, count(*)::INT AS w
      FROM draws JOIN quota USING (grp) JOIN numbered USING (grp, rn) WHERE draw < q GROUP BY 1, 2, 3)"""


MIXTURE = "alpha * n"
SUBGROUP = "(nb / n::DOUBLE + alpha * (1 - nb / n::DOUBLE)) * n"


@query(
    "dense_row_numbers",
    """SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('rows:' || c_custkey::VARCHAR), c_custkey) - 1 AS rn
    FROM customer""",
)
def dense_row_numbers(spark, sf):
    return N.number_rows(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", ["c_mktsegment"])


@query(
    "hash_split",
    f"""WITH {LINES_SQL} SELECT row_id, l_returnflag, k <= floor(0.5 * (SELECT count(*) FROM lines)) AS is_reference
    FROM {rank_sql("lines", "42", "split")}""",
)
def hash_split(spark, sf):
    return N.split_by_fraction(line_items(spark, sf), "row_id", 0.5, seed=SEED).select("row_id", "l_returnflag", "is_reference")


@query(
    "sample_class",
    f"""WITH {LINES_SQL} SELECT row_id, l_quantity FROM {rank_sql("(SELECT * FROM lines WHERE l_returnflag = 'R')", "42", "reference")} WHERE k <= 1000""",
)
def sample_class(spark, sf):
    """Reference sample: at most 1000 rows of one class."""
    rows = line_items(spark, sf).filter("l_returnflag = 'R'")
    return N.sample_rows(rows, "row_id", 1000, seed=SEED, tag="reference").select("row_id", "l_quantity")


@query(
    "sample_pool",
    f"""WITH {LINES_SQL} SELECT row_id, l_returnflag FROM {rank_sql("(SELECT * FROM lines WHERE l_returnflag IN ('R', 'N'))", "42", "pool")} WHERE k <= 3000""",
)
def sample_pool(spark, sf):
    """Pool sample: at most 3000 rows of two classes, drawn apart from the reference."""
    rows = line_items(spark, sf).filter(F.col("l_returnflag").isin("R", "N"))
    return N.sample_rows(rows, "row_id", 3000, seed=SEED, tag="pool").select("row_id", "l_returnflag")


EMBEDDED_SQL = "src AS (SELECT vec_id AS row_id, CASE label WHEN 0 THEN 'a' ELSE 'b' END AS grp FROM embeddings WHERE label IN (0, 1)),"


@query("mixture_weights", f"WITH {weights_sql('src', MIXTURE, ctes=EMBEDDED_SQL)} SELECT * FROM weights")
def mixture_weights(spark, sf):
    pool = table(spark, sf, "embeddings").filter("label IN (0, 1)").withColumnRenamed("vec_id", "row_id")
    return as_output(S.class_mixture_weights(pool, "label", 0, 1, GRID, n_runs=RUNS, seed=SEED))


RETURNED_SQL = f"{LINES_SQL}, src AS (SELECT row_id, CASE WHEN l_returnflag = 'R' THEN 'b' ELSE 'a' END AS grp FROM lines),"


@query(
    "subgroup_weights",
    f"""WITH {weights_sql('src', SUBGROUP, ctes=RETURNED_SQL)} SELECT alpha, run, count(*) AS n_rows, sum(w)::BIGINT AS n,
    sum(w) FILTER (l_returnflag = 'R')::BIGINT AS n_subgroup, round(sum(w * l_quantity) / sum(w), 6) AS mean_quantity
    FROM weights JOIN lines USING (row_id) GROUP BY 1, 2""",
)
def subgroup_weights(spark, sf):
    """Whole lineitem as the pool; each resample summed up."""
    lines = line_items(spark, sf).select("row_id", "l_returnflag", "l_quantity")
    drawn = S.subgroup_shift_counters(lines, in_subgroup("l_returnflag", "R"), GRID, n_runs=RUNS, seed=SEED)
    w = F.col("w").cast("bigint")
    joined = S.long_weights(drawn.join(lines, "row_id").drop("row_id"), GRID)
    return as_output(
        joined.groupBy("alpha", "run").agg(
            F.count("*").alias("n_rows"),
            F.sum(w).alias("n"),
            F.sum(F.when(F.col("l_returnflag") == "R", w)).alias("n_subgroup"),
            (F.sum(w * F.col("l_quantity")) / F.sum(w)).alias("mean_quantity"),
        )
    )


@query(
    "subgroup_weight_rows",
    f"WITH {weights_sql('src', SUBGROUP, ctes='src AS (SELECT c_custkey AS row_id, CASE WHEN c_mktsegment = {q}BUILDING{q} THEN {q}b{q} ELSE {q}a{q} END AS grp FROM customer),'.format(q=chr(39)))} SELECT * FROM weights",
)
def subgroup_weight_rows(spark, sf):
    pool = table(spark, sf, "customer").withColumnRenamed("c_custkey", "row_id")
    return as_output(S.subgroup_shift_weights(pool, in_subgroup("c_mktsegment", "BUILDING"), GRID, n_runs=RUNS, seed=SEED))


@query(
    "plain_bootstrap",
    f"""WITH src AS (SELECT c_custkey AS row_id, 'all' AS grp FROM customer), numbered AS {numbered_sql('src')},
    draws AS (SELECT run, {draw_sql("n", f"run + {SEED}", "'all'", "draw")} AS rn
      FROM (SELECT count(*) AS n FROM src), range({RUNS}) r(run), range((SELECT count(*) FROM src)) d(draw))
    SELECT run::INT AS run, row_id, count(*)::INT AS w FROM draws JOIN numbered USING (rn) GROUP BY 1, 2""",
)
def plain_bootstrap(spark, sf):
    pool = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"))
    return S.bootstrap_weights(pool, n_runs=RUNS, seed=SEED)


@query(
    "calibration_weights",
    f"WITH {weights_sql('src', MIXTURE, ctes=EMBEDDED_SQL, seed=SEED + RUNS, alphas=[0.0])} SELECT * FROM weights",
)
def calibration_weights(spark, sf):
    """Held-out unshifted resamples: seeds after those of the evaluation runs."""
    pool = table(spark, sf, "embeddings").filter("label IN (0, 1)").withColumnRenamed("vec_id", "row_id")
    return as_output(S.class_mixture_weights(pool, "label", 0, 1, [0.0], n_runs=RUNS, seed=SEED + RUNS))


@query(
    "missing_class_fallback",
    f"""WITH src AS (SELECT vec_id AS row_id, 'all' AS grp FROM embeddings WHERE label = 0), numbered AS {numbered_sql('src')},
    draws AS (SELECT run, {draw_sql("n", f"run + {SEED}", "'all'", "draw")} AS rn
      FROM (SELECT count(*) AS n FROM src), range({RUNS}) r(run), range((SELECT count(*) FROM src)) d(draw))
    SELECT alpha, run::INT AS run, row_id, count(*)::INT AS w FROM draws JOIN numbered USING (rn), (VALUES (0.0::DOUBLE), (0.5::DOUBLE)) t(alpha) GROUP BY 1, 2, 3""",
)
def missing_class_fallback(spark, sf):
    """A pool without the second class is resampled as a whole at every intensity."""
    pool = table(spark, sf, "embeddings").filter("label = 0").withColumnRenamed("vec_id", "row_id")
    return as_output(S.class_mixture_weights(pool, "label", 0, 1, [0.0, 0.5], n_runs=RUNS, seed=SEED))


@query("subgroup_share", "SELECT round(avg((l_returnflag = 'R')::INT::DOUBLE), 6) AS share FROM lineitem")
def subgroup_share(spark, sf):
    inside = in_subgroup("l_returnflag", "R").cast("double")
    return as_output(table(spark, sf, "lineitem").agg(F.avg(inside).alias("share")))
