"""Queries over stored scores and results: JSON and CSV round trips, resumed and merged work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators import metrics as M
from driftwell.operators import report as R
from driftwell.operators.numbering import number_rows
from driftwell.plans import runs
from driftwell.sources import results
from queries import query
from queries.common import METRICS_SQL, ROUNDED_METRICS, SCORES_SQL, as_output, event_calibration, event_scores
from queries.detectors import customer_domain
from queries.views import fresh_folder


def numbered_scores(spark, sf) -> DataFrame:
    """Event scores with the run as a dense number within (detector, alpha)."""
    numbered = number_rows(event_scores(spark, sf), "row_id", ["detector", "alpha"], out="run")
    return numbered.select("detector", "alpha", F.col("run").cast("int").alias("run"), "score")


NUMBERED_SQL = SCORES_SQL + """,
  numbered AS (SELECT detector, alpha, (row_number() OVER (PARTITION BY detector, alpha ORDER BY md5('rows:' || row_id::VARCHAR), row_id) - 1)::INT AS run, score FROM scores)"""


@query("scores_json_roundtrip", f"WITH {NUMBERED_SQL} SELECT detector, alpha, run, round(score, 6) AS score FROM numbered")
def scores_json_roundtrip(spark, sf):
    """Scores written as nested JSON and read back as rows."""
    path = fresh_folder(spark, "scores")
    results.write_scores_json(numbered_scores(spark, sf), path)
    return as_output(results.read_scores_json(spark, path))


@query(
    "calibration_json_roundtrip",
    f"""WITH {SCORES_SQL} SELECT detector, (row_number() OVER (PARTITION BY detector ORDER BY md5('rows:' || row_id::VARCHAR), row_id) - 1)::INT AS run,
      round(score, 6) AS score FROM calibration""",
)
def calibration_json_roundtrip(spark, sf):
    """Held-out scores written as JSON and read back as rows."""
    path = fresh_folder(spark, "calibration")
    numbered = number_rows(event_calibration(spark, sf), "row_id", ["detector"], out="run")
    results.write_calibration_json(numbered.select("detector", F.col("run").cast("int").alias("run"), "score"), path)
    return as_output(results.read_calibration_json(spark, path))


@query(
    "metrics_csv_by_domain",
    f"""WITH {METRICS_SQL}, m AS (SELECT {ROUNDED_METRICS} FROM metrics)
    SELECT domain, detector, alpha, "TPR", "FPR", "AUC_ROC", alpha_at_80_tpr FROM m, (VALUES ('first'), ('second')) d(domain)""",
)
def metrics_csv_by_domain(spark, sf):
    """Metrics written as CSV for two domains and read back; a third folder does not exist."""
    metrics = M.export_names(as_output(M.detection_metrics(event_scores(spark, sf), event_calibration(spark, sf))))
    folders = {d: fresh_folder(spark, d) for d in ("first", "second", "absent")}
    for d in ("first", "second"):
        results.write_table(metrics, folders[d])
    back = results.read_domain_metrics(spark, folders)
    return back.select("domain", "detector", "alpha", "TPR", "FPR", "AUC_ROC", F.col("`alpha@80%TPR`").alias("alpha_at_80_tpr"))


@query(
    "tpr_over_domains",
    f"""WITH {METRICS_SQL} SELECT domain, detector, alpha, round("TPR", 6) AS "TPR" FROM metrics, (VALUES ('first'), ('second')) d(domain)""",
)
def tpr_over_domains(spark, sf):
    """The sensitivity curves of several domains in one table."""
    metrics = M.detection_metrics(event_scores(spark, sf), event_calibration(spark, sf))
    both = metrics.withColumn("domain", F.explode(F.array(F.lit("first"), F.lit("second"))))
    return as_output(R.tpr_by_alpha(both))


@query(
    "pending_work",
    f"""WITH {NUMBERED_SQL}, plan AS (SELECT DISTINCT n.detector, a.alpha, r.run::INT AS run FROM numbered n,
      (SELECT DISTINCT alpha FROM numbered) a, range((SELECT max(run) + 1 FROM numbered)) r(run))
    SELECT detector, alpha, run FROM plan ANTI JOIN numbered USING (detector, alpha, run)""",
)
def pending_work(spark, sf):
    """A plan with as many runs everywhere as the longest cell has, less the scores there are."""
    done = numbered_scores(spark, sf)
    longest = done.agg(F.max("run")).first()[0] + 1
    names = [r[0] for r in done.select("detector").distinct().collect()]
    plan = runs.plan_work(spark, names, [i / 10 for i in range(11)], longest)
    return as_output(runs.pending_work(plan, done))


@query(
    "merge_previous_scores",
    f"""WITH {NUMBERED_SQL} SELECT detector, alpha, run, round(score + CASE WHEN detector IN ('click', 'error') THEN 1 ELSE 0 END, 6) AS score FROM numbered""",
)
def merge_previous_scores(spark, sf):
    """Two detectors scored anew; the scores of the others are kept."""
    previous = numbered_scores(spark, sf)
    new = previous.filter(F.col("detector").isin("click", "error")).withColumn("score", F.col("score") + 1)
    return as_output(runs.merge_scores(previous, new))


@query("resumed_run")
def resumed_run(spark, sf):
    """A customer run stopped after some intensities and taken up again from its store; each
    score depends on its own resample only, so it equals an uninterrupted run (see tests)."""
    domain = customer_domain(spark, sf)
    store = runs.Store(spark, fresh_folder(spark, "run"))
    options = {"n_runs": 3, "detectors": ["distance", "columns"], "alphas_per_save": 2}
    runs.run_domain(domain, store, alphas=[0.0, 0.5], **options)
    return as_output(runs.run_domain(domain, store, alphas=[0.0, 0.5, 1.0], **options))
