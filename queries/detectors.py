"""Detector queries: the vector table under a class-mixture shift, customers as a mixed table,
event series, and the whole chain from resamples to detection metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import metrics as M
from driftwell.operators import resample as S
from driftwell.operators.kernel_tests import lsdd_scores, median_squared_distance, mmd_scores, mmd_statistics
from driftwell.operators.neighbours import neighbour_kl_scores
from driftwell.operators.pairs import mean_distances, nearest_distances
from driftwell.operators.projected import distance_scores
from driftwell.plans.domains import create_domain, draw_grid
from driftwell.plans.runs import score_grid, split_phases
from driftwell.session import cut_lineage
from queries import query
from queries.common import METRICS_SQL, ROUNDED_METRICS, SCORES_SQL, as_output, table
from queries.resample import MIXTURE, SUBGROUP, rank_sql, weights_sql
from queries.views import SERIES_SQL, event_series

SEED = 42
GRID = [0.0, 0.5, 1.0]
RUNS = 3
N_PERMUTATIONS = 20


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"), "label"
    )


def vector_sides(spark, sf):
    """(reference, pool with labels): all rows of class 0, and of classes 0 and 1."""
    pool = cut_lineage(vectors(spark, sf).filter("label IN (0, 1)"))
    return pool.filter("label = 0").select("row_id", "v"), pool


def vector_grid(spark, sf, alphas=GRID, runs=RUNS):
    reference, pool = vector_sides(spark, sf)
    weights = cut_lineage(S.class_mixture_weights(pool, "label", 0, 1, alphas, n_runs=runs, seed=SEED))
    return reference, pool.select("row_id", "v"), weights


VECTOR_SIDES_SQL = """emb AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE label IN (0, 1)),
  ref AS (SELECT row_id, v FROM emb WHERE label = 0),
  pool AS (SELECT row_id, v, label FROM emb),
  src AS (SELECT row_id, CASE label WHEN 0 THEN 'a' ELSE 'b' END AS grp FROM pool),"""


def vector_sql(alphas=GRID, runs=RUNS):
    return weights_sql("src", MIXTURE, ctes=VECTOR_SIDES_SQL, alphas=alphas, runs=runs)


ALL_VECTORS = "x AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS v FROM embeddings)"


@query(
    "pair_mean_distance",
    f"WITH {ALL_VECTORS} SELECT a.row_id, round(avg(list_distance(a.v, b.v)), 6) AS mean_distance FROM x a, x b GROUP BY 1",
)
def pair_mean_distance(spark, sf):
    rows = vectors(spark, sf)
    return as_output(mean_distances(rows, rows))


@query(
    "pair_mean_distance_tiled",
    f"WITH {ALL_VECTORS} SELECT a.row_id, round(avg(list_distance(a.v, b.v)), 6) AS mean_distance FROM x a, x b GROUP BY 1",
)
def pair_mean_distance_tiled(spark, sf):
    """The same through hash blocks, as for sides too large to share."""
    rows = vectors(spark, sf)
    return as_output(mean_distances(rows, rows, share=False))


KTH_SQL = f"""WITH {ALL_VECTORS}, d AS (SELECT a.row_id, list_distance(a.v, b.v) AS d FROM x a, x b),
  r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d) AS k FROM d)
  SELECT row_id, round(d, 6) AS kth_distance FROM r WHERE k = 5"""


@query("knn_kth_distance", KTH_SQL)
def knn_kth_distance(spark, sf):
    rows = vectors(spark, sf)
    return as_output(nearest_distances(rows, rows, 5))


@query("knn_kth_distance_tiled", KTH_SQL)
def knn_kth_distance_tiled(spark, sf):
    rows = vectors(spark, sf)
    return as_output(nearest_distances(rows, rows, 5, share=False))


PART_KTH_SQL = """WITH x AS (SELECT p_partkey AS row_id, [p_size::DOUBLE, p_retailprice / 20] AS v FROM part),
  d AS (SELECT a.row_id, list_distance(a.v, b.v) AS d FROM x a, x b),
  r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d) AS k FROM d)
  SELECT row_id, round(d, 6) AS kth_distance FROM r WHERE k = 5"""


@query("knn_kth_distance_indexed", PART_KTH_SQL)
def knn_kth_distance_indexed(spark, sf):
    """Parts by size and price through the pivot index, which excludes most pairs there."""
    sizes = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 20)
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), sizes.alias("v"))
    return as_output(nearest_distances(rows, rows, 5, share=False, index=True))


KL_SQL = """,
  dr AS (SELECT p.row_id, list_distance(p.v, r.v) AS d FROM pool p, ref r),
  rho AS (SELECT row_id, greatest(d, 1e-12) AS rho FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d) AS k FROM dr) WHERE k = 5),
  dp AS (SELECT a.row_id, b.row_id AS other, list_distance(a.v, b.v) AS d FROM pool a, pool b),
  near AS (SELECT i.alpha, i.run, i.row_id, i.w, d, sum(o.w) OVER (PARTITION BY i.alpha, i.run, i.row_id ORDER BY d) AS upto
    FROM weights i JOIN dp ON dp.row_id = i.row_id JOIN weights o ON o.row_id = dp.other AND o.alpha = i.alpha AND o.run = i.run),
  nu AS (SELECT alpha, run, row_id, max(w) AS w, greatest(min(d) FILTER (upto >= 6), 1e-12) AS nu FROM near GROUP BY 1, 2, 3),
  kl AS (SELECT alpha, run, greatest(0, {d} * sum(w * ln(rho / nu)) / sum(w) + ln((SELECT count(*) FROM ref)::DOUBLE / (sum(w) - 1))) AS score
    FROM nu JOIN rho USING (row_id) GROUP BY 1, 2)
  SELECT alpha, run, round(score, 6) AS score FROM kl"""


@query("knn_kl_score", f"WITH {vector_sql()} {KL_SQL.format(d=64)}")
def knn_kl_score(spark, sf):
    return as_output(neighbour_kl_scores(*vector_grid(spark, sf)))


@query("knn_kl_score_tiled", f"WITH {vector_sql()} {KL_SQL.format(d=64)}")
def knn_kl_score_tiled(spark, sf):
    return as_output(neighbour_kl_scores(*vector_grid(spark, sf), share=False))


DISTANCE_SQL = """,
  dbar AS (SELECT p.row_id, avg(list_distance(p.v, r.v)) AS m FROM pool p, ref r GROUP BY 1),
  base AS (SELECT avg(list_distance(a.v, b.v)) AS m FROM ref a, ref b),
  dist AS (SELECT alpha, run, abs(sum(w * d.m) / sum(w) - max(b.m)) AS score FROM weights JOIN dbar d USING (row_id), base b GROUP BY 1, 2)"""


@query("distance_score", f"WITH {vector_sql()} {DISTANCE_SQL} SELECT alpha, run, round(score, 6) AS score FROM dist")
def distance_score(spark, sf):
    return as_output(distance_scores(*vector_grid(spark, sf), n_components=None))


CUSTOMER_SQL = f"""rows AS (SELECT c_custkey AS row_id, c_mktsegment AS seg, [c_nationkey::DOUBLE, c_acctbal::FLOAT::DOUBLE, (c_mktsegment = 'AUTOMOBILE')::INT::DOUBLE,
    (c_mktsegment = 'BUILDING')::INT::DOUBLE, (c_mktsegment = 'FURNITURE')::INT::DOUBLE, (c_mktsegment = 'HOUSEHOLD')::INT::DOUBLE,
    (c_mktsegment = 'MACHINERY')::INT::DOUBLE] AS v FROM customer),
  split AS (SELECT *, k <= floor(0.5 * (SELECT count(*) FROM rows)) AS is_reference FROM {rank_sql("rows", "42", "split")}),
  ref AS (SELECT * FROM split WHERE is_reference), pool AS (SELECT * FROM split WHERE NOT is_reference),
  src AS (SELECT row_id, CASE WHEN seg = 'BUILDING' THEN 'b' ELSE 'a' END AS grp FROM pool),"""


def customer_domain(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return create_domain(
        "table", table=rows, row_id="c_custkey", subgroup_column="c_mktsegment", subgroup_value="BUILDING", seed=SEED
    )


@query(
    "projected_distance_score",
    f"WITH {weights_sql('src', SUBGROUP, ctes=CUSTOMER_SQL, alphas=GRID)} {DISTANCE_SQL} SELECT alpha, run, round(score, 4) AS score FROM dist",
)
def projected_distance_score(spark, sf):
    """Customers one-hot encoded; the components asked for cover the full width, so the
    projection keeps the distances that the SQL takes."""
    domain = customer_domain(spark, sf)
    weights = cut_lineage(domain.draw(GRID, RUNS, SEED))
    return as_output(distance_scores(*domain.numeric, weights, n_components=16), 4)


@query(
    "table_kl_score",
    f"WITH {weights_sql('src', SUBGROUP, ctes=CUSTOMER_SQL, alphas=[0.0, 1.0], runs=2)} {KL_SQL.format(d=7)}",
)
def table_kl_score(spark, sf):
    domain = customer_domain(spark, sf)
    return as_output(neighbour_kl_scores(*domain.reduced, cut_lineage(domain.draw([0.0, 1.0], 2, SEED))))


# ---- kernel tests

BANDWIDTH_SQL = "(SELECT median(list_distance(a.v, b.v) ^ 2) FROM ref a, ref b WHERE a.row_id < b.row_id)"

UNION_SQL = """,
  items AS (SELECT alpha, run, 'r:' || row_id::VARCHAR AS uid, 1 AS copy FROM ref, (SELECT DISTINCT alpha, run FROM weights)
    UNION ALL SELECT alpha, run, 't:' || row_id::VARCHAR, unnest(range(1, w + 1)) FROM weights),
  points AS (SELECT 'r:' || row_id::VARCHAR AS uid, v FROM ref UNION ALL SELECT 't:' || row_id::VARCHAR, v FROM pool),
  kern AS (SELECT a.uid AS p, b.uid AS q, exp(-(list_distance(a.v, b.v) ^ 2) / (SELECT m FROM width)) AS k FROM points a, points b),
  size AS (SELECT count(*)::DOUBLE AS m FROM ref)"""


def mmd_sql(labels: str, extra: str) -> str:
    """CTEs ending in ``mmd(alpha, run, extra, mmd2)`` from item counts per side
    ``sides(alpha, run, extra, uid, u, t)``: copies on the reference side and in all."""
    return f""",
  width AS (SELECT {BANDWIDTH_SQL} AS m){UNION_SQL},
  sides AS ({labels}),
  forms AS (SELECT a.alpha, a.run, a.{extra}, sum(a.u * b.u * k) AS uu, sum(a.u * (b.t - b.u) * k) AS ut, sum((a.t - a.u) * (b.t - b.u) * k) AS tt
    FROM sides a JOIN sides b ON a.alpha = b.alpha AND a.run = b.run AND a.{extra} = b.{extra} JOIN kern ON p = a.uid AND q = b.uid GROUP BY 1, 2, 3),
  totals AS (SELECT alpha, run, sum(w)::DOUBLE AS n FROM weights GROUP BY 1, 2),
  mmd AS (SELECT f.alpha, f.run, {extra}, (uu - m) / (m * (m - 1)) + (tt - n) / (n * (n - 1)) - 2 * ut / (m * n) AS mmd2
    FROM forms f JOIN totals USING (alpha, run), size)"""


OBSERVED = "SELECT alpha, run, -1 AS perm, uid, sum((uid LIKE 'r:%')::INT) AS u, count(*) AS t FROM items GROUP BY 1, 2, 3, 4"
RELABELLED = f"""SELECT alpha, run, perm, uid, sum((k <= m)::INT) AS u, count(*) AS t FROM
    (SELECT *, row_number() OVER (PARTITION BY alpha, run, perm ORDER BY md5(concat_ws(':', 'perm', '{SEED}', run::VARCHAR, perm::VARCHAR, uid, copy::VARCHAR)), uid, copy) AS k
     FROM items, range({N_PERMUTATIONS}) p(perm)), size GROUP BY 1, 2, 3, 4"""


@query(
    "rbf_bandwidth",
    f"WITH {VECTOR_SIDES_SQL.rstrip(',')} SELECT round({BANDWIDTH_SQL}, 6) AS median_d2, round(sqrt({BANDWIDTH_SQL} / 2), 6) AS sigma",
)
def rbf_bandwidth(spark, sf):
    reference, _ = vector_sides(spark, sf)
    d2 = median_squared_distance(reference)
    return as_output(spark.createDataFrame([(d2, (d2 / 2) ** 0.5)], "median_d2 double, sigma double"))


@query(
    "mmd_statistic",
    f"WITH {vector_sql()} {mmd_sql(OBSERVED, 'perm')} SELECT alpha, run, round(mmd2, 8) AS mmd2 FROM mmd",
)
def mmd_statistic(spark, sf):
    return as_output(mmd_statistics(*vector_grid(spark, sf)).drop("perm"), 8)


@query(
    "mmd_permutation_pvalue",
    f"""WITH {vector_sql(alphas=[0.0, 1.0])} {mmd_sql(f"{OBSERVED} UNION ALL {RELABELLED}", 'perm')},
    seen AS (SELECT alpha, run, mmd2 AS s FROM mmd WHERE perm = -1)
    SELECT alpha, run, round(max(s), 8) AS mmd2, round(avg((mmd2 >= s)::INT::DOUBLE), 6) AS p_value, round(1 - avg((mmd2 >= s)::INT::DOUBLE), 6) AS score
    FROM mmd JOIN seen USING (alpha, run) WHERE perm >= 0 GROUP BY 1, 2""",
)
def mmd_permutation_pvalue(spark, sf):
    reference, pool, weights = vector_grid(spark, sf, alphas=[0.0, 1.0])
    scored = mmd_scores(reference, pool, weights, n_permutations=N_PERMUTATIONS, seed=SEED)
    return as_output(scored, 8)


@query("lsdd_score")
def lsdd_score(spark, sf):
    """Needs a matrix inverse, so there is no SQL form; the tests compare it with numpy."""
    reference, pool, weights = vector_grid(spark, sf, alphas=[0.0, 1.0])
    return as_output(lsdd_scores(reference, pool, weights, n_permutations=N_PERMUTATIONS, seed=SEED))


# ---- series domain

SERIES_KL_SQL = f"""{SERIES_SQL},
  rows AS (SELECT row_id, event_type, list(x ORDER BY d) AS v FROM series WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2),
  ref AS (SELECT row_id, v FROM rows WHERE event_type = 'click'),
  pool AS (SELECT * FROM rows), src AS (SELECT row_id, CASE event_type WHEN 'click' THEN 'a' ELSE 'b' END AS grp FROM pool),"""


def series_domain(spark, sf):
    series = cut_lineage(event_series(spark, sf).withColumnRenamed("event_type", "label"))
    return create_domain("series", series=series, class_a="click", class_b="purchase", seed=SEED)


@query(
    "series_kl_score",
    f"WITH {weights_sql('src', MIXTURE, ctes=SERIES_KL_SQL, alphas=[0.0, 1.0], runs=2)} {KL_SQL.format(d=30)}",
)
def series_kl_score(spark, sf):
    domain = series_domain(spark, sf)
    return as_output(neighbour_kl_scores(*domain.reduced, cut_lineage(domain.draw([0.0, 1.0], 2, SEED))))


@query(
    "series_distance_score",
    f"WITH {weights_sql('src', MIXTURE, ctes=SERIES_KL_SQL, alphas=GRID)} {DISTANCE_SQL} SELECT alpha, run, round(score, 6) AS score FROM dist",
)
def series_distance_score(spark, sf):
    domain = series_domain(spark, sf)
    weights = cut_lineage(domain.draw(GRID, RUNS, SEED))
    return as_output(distance_scores(*domain.numeric, weights, n_components=None))


# ---- from resamples to metrics

FLAGSHIP_RUNS = 10
# held-out run r has the seed after the evaluation runs, so both come from one draw of twice as many
CHAIN_SQL = (
    vector_sql(runs=2 * FLAGSHIP_RUNS)
    + DISTANCE_SQL
    + f""",
scores AS (SELECT 'distance' AS detector, alpha, score FROM dist WHERE run < {FLAGSHIP_RUNS}),
calibration AS (SELECT 'distance' AS detector, score FROM dist WHERE run >= {FLAGSHIP_RUNS} AND alpha = 0)"""
)


@query(
    "shift_detection_metrics",
    f"WITH {METRICS_SQL.replace(SCORES_SQL, CHAIN_SQL)} SELECT {ROUNDED_METRICS} FROM metrics",
)
def shift_detection_metrics(spark, sf):
    """Resample grid, calibration, distance scores and all detection metrics."""
    reference, pool = vector_sides(spark, sf)
    evaluation = S.class_mixture_weights(pool, "label", 0, 1, GRID, n_runs=FLAGSHIP_RUNS, seed=SEED)
    held_out = S.class_mixture_weights(pool, "label", 0, 1, [0.0], n_runs=FLAGSHIP_RUNS, seed=SEED + FLAGSHIP_RUNS)
    weights = evaluation.withColumn("phase", F.lit("evaluation")).unionByName(
        held_out.withColumn("phase", F.lit("calibration"))
    )
    scored = distance_scores(reference, pool.select("row_id", "v"), cut_lineage(weights), n_components=None)
    scores, calibration = split_phases(cut_lineage(scored.withColumn("detector", F.lit("distance"))))
    return as_output(M.detection_metrics(scores, calibration))


@query("all_detectors_on_vectors")
def all_detectors_on_vectors(spark, sf):
    """Five detectors over one resample grid with PCA views; the projections and the
    density difference have no SQL form."""
    domain = create_domain("vectors", vectors=vectors(spark, sf), seed=SEED)
    weights = cut_lineage(draw_grid(domain, [0.0, 1.0], 2, SEED))
    settings = {"mmd": {"n_permutations": 10}, "lsdd": {"n_permutations": 10}}
    return as_output(score_grid(domain, weights, settings=settings))


@query("text_detectors")
def text_detectors(spark, sf):
    """Documents in two languages as TF-IDF vectors, distance and column detectors."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label")
    )
    domain = create_domain("text", documents=docs, class_a="en", class_b="de", seed=SEED)
    weights = cut_lineage(draw_grid(domain, [0.0, 0.1], 2, SEED))
    return as_output(score_grid(domain, weights, ["distance", "columns"]))
