"""Metric-layer queries over the event score table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators import metrics as M
from driftwell.operators import report as R
from driftwell.operators.resample import bootstrap_weights
from queries import query
from queries.common import (
    AUC_SQL,
    CURVE_SQL,
    METRICS_SQL,
    ROUNDED_METRICS,
    SCORES_SQL,
    THRESHOLD_SQL,
    as_output,
    draw_sql,
    event_calibration,
    event_scores,
    table,
)

SUMMARY_COLUMNS = ["detector", "TNR", "AUC_TPR", "alpha_at_80_tpr", "tpr_at_alpha_05"]


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    scores = event_scores(spark, sf)
    return M.tpr_curve(M.flag_rates(scores, M.thresholds(scores, event_calibration(spark, sf))))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.detection_metrics(event_scores(spark, sf), event_calibration(spark, sf))


@query("threshold_percentile", f"WITH {THRESHOLD_SQL} SELECT detector, round(threshold, 6) AS threshold FROM cuts")
def threshold_percentile(spark, sf):
    return as_output(M.thresholds(event_scores(spark, sf), event_calibration(spark, sf)))


@query(
    "threshold_without_calibration",
    f"""WITH {SCORES_SQL} SELECT detector, round(quantile_cont(score, 0.95), 6) AS threshold
    FROM scores WHERE alpha = 0 GROUP BY 1""",
)
def threshold_without_calibration(spark, sf):
    return as_output(M.thresholds(event_scores(spark, sf)))


@query(
    "flag_rates",
    f"""WITH {CURVE_SQL} SELECT detector, alpha, n, round(flag_rate, 6) AS flag_rate,
    round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score FROM rates""",
)
def flag_rates(spark, sf):
    scores = event_scores(spark, sf)
    return as_output(M.flag_rates(scores, M.thresholds(scores, event_calibration(spark, sf))))


@query("tnr", f'WITH {CURVE_SQL} SELECT detector, round("TNR", 6) AS "TNR" FROM summary')
def tnr(spark, sf):
    return as_output(M.curve_summary(_curve(spark, sf)).select("detector", "TNR"))


@query("auc_tpr", f'WITH {CURVE_SQL} SELECT detector, round("AUC_TPR", 6) AS "AUC_TPR" FROM summary')
def auc_tpr(spark, sf):
    return as_output(M.curve_summary(_curve(spark, sf)).select("detector", "AUC_TPR"))


@query("alpha_at_80", f"WITH {CURVE_SQL} SELECT detector, alpha_at_80_tpr FROM summary")
def alpha_at_80(spark, sf):
    return as_output(M.curve_summary(_curve(spark, sf)).select("detector", "alpha_at_80_tpr"))


@query("tpr_at_half", f"WITH {CURVE_SQL} SELECT detector, round(tpr_at_alpha_05, 6) AS tpr_at_alpha_05 FROM summary")
def tpr_at_half(spark, sf):
    return as_output(M.curve_summary(_curve(spark, sf)).select("detector", "tpr_at_alpha_05"))


@query("auc_roc", f'WITH {SCORES_SQL} {AUC_SQL} SELECT detector, round("AUC_ROC", 6) AS "AUC_ROC" FROM roc')
def auc_roc(spark, sf):
    return as_output(M.auc_roc(event_scores(spark, sf)))


@query("detection_metrics", f"WITH {METRICS_SQL} SELECT {ROUNDED_METRICS} FROM metrics")
def detection_metrics(spark, sf):
    return as_output(_metrics(spark, sf))


@query(
    "metrics_export_names",
    f"""WITH {METRICS_SQL} SELECT * RENAME (alpha_at_80_tpr AS "alpha@80%TPR", tpr_at_alpha_05 AS "TPR@alpha=0.5")
    FROM (SELECT {ROUNDED_METRICS} FROM metrics)""",
)
def metrics_export_names(spark, sf):
    return M.export_names(as_output(_metrics(spark, sf)))


PARTIAL_SQL = METRICS_SQL.replace("FROM events WHERE day(ts) <= 22)", "FROM events WHERE day(ts) <= 22 AND (day(ts) - 1) % 11 <= 6)")


@query("partial_metrics", f"WITH {PARTIAL_SQL} SELECT {ROUNDED_METRICS} FROM metrics")
def partial_metrics(spark, sf):
    scores = event_scores(spark, sf)
    finished = scores.filter("alpha <= 0.6").select("detector", "alpha")
    return as_output(M.finished_metrics(scores, finished, event_calibration(spark, sf)))


N_BOOT = 20


@query(
    "bootstrap_auc_interval",
    f"""WITH {SCORES_SQL},
    numbered AS (SELECT *, row_number() OVER (ORDER BY md5('rows:' || row_id::VARCHAR), row_id) - 1 AS rn FROM scores),
    size AS (SELECT count(*) AS n FROM scores),
    draws AS (SELECT run, {draw_sql("n", "run + 42", "'all'", "draw")} AS rn
      FROM size, range({N_BOOT}) r(run), range((SELECT n FROM size)) d(draw)),
    drawn AS (SELECT run, detector, alpha > 0 AS pos, score FROM draws JOIN numbered USING (rn)),
    ranked AS (SELECT run, detector, pos, rank() OVER (PARTITION BY run, detector ORDER BY score)
        + (count(*) OVER (PARTITION BY run, detector, score) - 1) / 2.0::DOUBLE AS r FROM drawn),
    aucs AS (SELECT run, detector, count(*) FILTER (pos) AS n1, count(*) FILTER (NOT pos) AS n0,
        sum(r) FILTER (pos) AS r1 FROM ranked GROUP BY 1, 2),
    a AS (SELECT detector, (r1 - n1 * (n1 + 1) / 2.0::DOUBLE) / (n0::DOUBLE * n1) AS auc FROM aucs WHERE n0 > 0 AND n1 > 0)
    SELECT detector, round(quantile_cont(auc, 0.025), 6) AS auc_low, round(quantile_cont(auc, 0.975), 6) AS auc_high
    FROM a GROUP BY 1""",
)
def bootstrap_auc_interval(spark, sf):
    scores = event_scores(spark, sf)
    return as_output(M.auc_interval(scores, bootstrap_weights(scores, n_runs=N_BOOT)))


# ---- calibration report


N_RUNS = 100

REPORT_SQL = f"""WITH {METRICS_SQL},
base AS (SELECT 'events' AS domain, detector, "FPR", round_even("FPR" * {N_RUNS}, 0)::INT AS n_fp, "AUC_ROC" FROM metrics WHERE alpha = 0),
logs AS (SELECT k, coalesce(sum(CASE WHEN k > 0 THEN ln(({N_RUNS} - k + 1)::DOUBLE / k) END) OVER (ORDER BY k), 0)
   + k * ln(0.05::DOUBLE) + ({N_RUNS} - k) * ln(0.95::DOUBLE) AS lp FROM range(0, {N_RUNS + 1}) t(k)),
pmf AS (SELECT k, exp(lp) AS q FROM logs),
tails AS (SELECT o.k AS n_fp, least(1.0, sum(p.q) FILTER (p.q <= o.q * (1 + 1e-7))) AS p_binomial FROM pmf o, pmf p GROUP BY 1),
report AS (SELECT domain, detector, "FPR", n_fp,
  greatest(0, (n_fp / {N_RUNS}::DOUBLE + z * z / (2 * {N_RUNS})) / (1 + z * z / {N_RUNS})
   - z * sqrt(n_fp / {N_RUNS}::DOUBLE * (1 - n_fp / {N_RUNS}::DOUBLE) / {N_RUNS} + z * z / (4 * {N_RUNS} * {N_RUNS})) / (1 + z * z / {N_RUNS})) AS lo,
  least(1, (n_fp / {N_RUNS}::DOUBLE + z * z / (2 * {N_RUNS})) / (1 + z * z / {N_RUNS})
   + z * sqrt(n_fp / {N_RUNS}::DOUBLE * (1 - n_fp / {N_RUNS}::DOUBLE) / {N_RUNS} + z * z / (4 * {N_RUNS} * {N_RUNS})) / (1 + z * z / {N_RUNS})) AS hi,
  p_binomial, "AUC_ROC"
  FROM base JOIN tails USING (n_fp), (SELECT 1.959963984540054::DOUBLE AS z))"""


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return R.calibration_report(_metrics(spark, sf).withColumn("domain", F.lit("events")), n_runs=N_RUNS)


@query(
    "calibration_report",
    REPORT_SQL
    + """ SELECT domain, detector, round("FPR", 6) AS "FPR", n_fp, round(lo, 6) AS "CI_low_wilson",
    round(hi, 6) AS "CI_high_wilson", round(p_binomial, 6) AS p_binomial, round("AUC_ROC", 6) AS "AUC_ROC" FROM report""",
)
def calibration_report(spark, sf):
    return as_output(_report(spark, sf))


@query(
    "wilson_interval",
    REPORT_SQL + ' SELECT detector, n_fp, round(lo, 6) AS "CI_low_wilson", round(hi, 6) AS "CI_high_wilson" FROM report',
)
def wilson_interval(spark, sf):
    return as_output(_report(spark, sf).select("detector", "n_fp", "CI_low_wilson", "CI_high_wilson"))


@query("binomial_test", REPORT_SQL + " SELECT detector, n_fp, round(p_binomial, 6) AS p_binomial FROM report")
def binomial_test(spark, sf):
    return as_output(_report(spark, sf).select("detector", "n_fp", "p_binomial"))


# ---- figure tables


@query("tpr_by_alpha", f'WITH {METRICS_SQL} SELECT detector, alpha, round("TPR", 6) AS "TPR" FROM metrics')
def tpr_by_alpha(spark, sf):
    return as_output(R.tpr_by_alpha(_metrics(spark, sf)))


@query("auc_by_detector", f'WITH {METRICS_SQL} SELECT detector, round(max("AUC_TPR"), 6) AS "AUC_TPR" FROM metrics GROUP BY 1')
def auc_by_detector(spark, sf):
    return as_output(R.auc_by_detector(_metrics(spark, sf)))


@query(
    "fpr_vs_nominal",
    f'WITH {METRICS_SQL} SELECT detector, round("FPR", 6) AS "FPR", 0.05::DOUBLE AS nominal FROM metrics WHERE alpha = 0',
)
def fpr_vs_nominal(spark, sf):
    return as_output(R.fpr_against_nominal(_metrics(spark, sf)))


def box_sql(source: str, groups: str, value: str) -> str:
    """Five-number summary in SQL over the CTE or table ``source``."""
    return f"""q AS (SELECT {groups}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
      quantile_cont({value}, 0.75) AS q3 FROM {source} GROUP BY {groups}),
    boxes AS (SELECT {groups}, count(*) AS n,
      min({value}) FILTER ({value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
      max(q1) AS q1, max(median) AS median, max(q3) AS q3,
      max({value}) FILTER ({value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
      count(*) FILTER (NOT {value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
      FROM {source} JOIN q USING ({groups}) GROUP BY {groups})
    SELECT {groups}, n, round(whisker_low, 6) AS whisker_low, round(q1, 6) AS q1, round(median, 6) AS median,
      round(q3, 6) AS q3, round(whisker_high, 6) AS whisker_high, n_outliers FROM boxes"""


@query(
    "score_box_stats",
    f"WITH {SCORES_SQL}, h0 AS (SELECT * FROM scores WHERE alpha = 0), {box_sql('h0', 'detector', 'score')}",
)
def score_box_stats(spark, sf):
    return as_output(R.unshifted_score_boxes(event_scores(spark, sf)))


@query(
    "score_box_stats_without_one",
    f"WITH {SCORES_SQL}, h0 AS (SELECT * FROM scores WHERE alpha = 0 AND detector <> 'error'), {box_sql('h0', 'detector', 'score')}",
)
def score_box_stats_without_one(spark, sf):
    return as_output(R.unshifted_score_boxes(event_scores(spark, sf), without=["error"]))


@query(
    "mean_score_monotonicity",
    f"""WITH {METRICS_SQL} SELECT detector, alpha, round(mean_score, 6) AS mean_score,
    coalesce((mean_score < lag(mean_score) OVER (PARTITION BY detector ORDER BY alpha))::INT, 0) AS falls FROM metrics""",
)
def mean_score_monotonicity(spark, sf):
    return as_output(R.mean_score_steps(_metrics(spark, sf)))
