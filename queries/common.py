"""Inputs shared by the queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(col: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def as_output(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and turn the decimal alpha into a double."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "double":
            out.append(rounded(f"`{f.name}`", digits).alias(f.name))
        elif kind == "decimal":
            out.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


# ---- a score table read off the event stream: the event types play the detectors,
# days 1-22 run through the shift grid twice, later days are the held-out scores


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, detector, alpha, score)."""
    ev = table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts")).filter("day <= 22")
    step = (F.col("day") - 1) % 11
    return ev.select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("detector"),
        (step / F.lit(10)).cast("decimal(6,4)").alias("alpha"),
        (F.col("value") + F.lit(400.0) * (step / F.lit(10))).alias("score"),
    )


def event_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, detector, score)."""
    ev = table(spark, sf_dir, "events").filter(F.dayofmonth("ts") > 22)
    return ev.select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("detector"), F.col("value").alias("score")
    )


SCORES_SQL = """
scores AS (
  SELECT event_id AS row_id, event_type AS detector, ((day(ts) - 1) % 11)::DOUBLE / 10::DOUBLE AS alpha,
         value + 400::DOUBLE * (((day(ts) - 1) % 11)::DOUBLE / 10::DOUBLE) AS score
  FROM events WHERE day(ts) <= 22),
calibration AS (
  SELECT event_id AS row_id, event_type AS detector, value AS score FROM events WHERE day(ts) > 22)"""

THRESHOLD_SQL = (
    SCORES_SQL
    + """,
cuts AS (
  SELECT o.detector, coalesce(c.t, o.t) AS threshold
  FROM (SELECT detector, quantile_cont(score, 0.95) AS t FROM scores WHERE alpha = 0 GROUP BY 1) o
  LEFT JOIN (SELECT detector, quantile_cont(score, 0.95) AS t FROM calibration GROUP BY 1) c USING (detector))"""
)

CURVE_SQL = (
    THRESHOLD_SQL
    + """,
rates AS (
  SELECT detector, alpha, count(*) AS n, avg((score > threshold)::INT::DOUBLE) AS flag_rate,
         avg(score) AS mean_score, stddev_pop(score) AS std_score
  FROM scores JOIN cuts USING (detector) GROUP BY 1, 2),
curve AS (
  SELECT detector, alpha, CASE WHEN alpha = 0 THEN 0.0::DOUBLE ELSE flag_rate END AS "TPR",
         CASE WHEN alpha = 0 THEN flag_rate ELSE 1 - flag_rate END AS "FPR",
         flag_rate AS "Precision", flag_rate AS "F1", mean_score, std_score
  FROM rates),
steps AS (
  SELECT *, alpha - lag(alpha) OVER w AS da, ("TPR" + lag("TPR") OVER w) / 2 AS mid,
         lag(alpha) OVER w AS a0, lag("TPR") OVER w AS t0
  FROM curve WINDOW w AS (PARTITION BY detector ORDER BY alpha)),
summary AS (
  SELECT detector, max(CASE WHEN alpha = 0 THEN 1 - "FPR" END) AS "TNR",
         CASE WHEN count(*) > 1 THEN sum(mid * da) / (max(alpha) - min(alpha)) ELSE 0 END AS "AUC_TPR",
         min(CASE WHEN alpha > 0 AND "TPR" >= 0.8 THEN alpha END) AS alpha_at_80_tpr,
         CASE WHEN count(*) > 1 THEN coalesce(
             max(CASE WHEN a0 < 0.5 AND alpha >= 0.5 THEN t0 + ("TPR" - t0) * (0.5 - a0) / (alpha - a0) END),
             CASE WHEN max(alpha) < 0.5 THEN arg_max("TPR", alpha) ELSE arg_min("TPR", alpha) END)
         ELSE 0 END AS tpr_at_alpha_05
  FROM steps GROUP BY 1)"""
)

AUC_SQL = """,
ranked AS (
  SELECT detector, alpha > 0 AS pos,
         rank() OVER (PARTITION BY detector ORDER BY score)
           + (count(*) OVER (PARTITION BY detector, score) - 1) / 2.0::DOUBLE AS r
  FROM scores),
roc AS (
  SELECT detector, CASE WHEN n1 = 0 OR n0 = 0 THEN 0.5 ELSE (r1 - n1 * (n1 + 1) / 2.0::DOUBLE) / (n0::DOUBLE * n1) END AS "AUC_ROC"
  FROM (SELECT detector, count(*) FILTER (pos) AS n1, count(*) FILTER (NOT pos) AS n0,
               coalesce(sum(r) FILTER (pos), 0) AS r1 FROM ranked GROUP BY 1))"""

METRICS_SQL = (
    CURVE_SQL
    + AUC_SQL
    + """,
metrics AS (
  SELECT c.*, s."TNR", s."AUC_TPR", s.alpha_at_80_tpr, s.tpr_at_alpha_05, r."AUC_ROC"
  FROM curve c JOIN summary s USING (detector) JOIN roc r USING (detector))"""
)

ROUNDED_METRICS = """detector, alpha, round("TPR", 6) AS "TPR", round("FPR", 6) AS "FPR",
  round("Precision", 6) AS "Precision", round("F1", 6) AS "F1", round(mean_score, 6) AS mean_score,
  round(std_score, 6) AS std_score, round("TNR", 6) AS "TNR", round("AUC_TPR", 6) AS "AUC_TPR",
  round(alpha_at_80_tpr, 6) AS alpha_at_80_tpr, round(tpr_at_alpha_05, 6) AS tpr_at_alpha_05,
  round("AUC_ROC", 6) AS "AUC_ROC" """


def draw_sql(size: str, *parts: str) -> str:
    """The index draw of ``driftwell.functions.hashing`` in SQL."""
    key = "concat_ws(':', " + ", ".join(f"({p})::VARCHAR" for p in parts) + ")"
    return f"floor(('0x' || substr(md5({key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE * ({size})::DOUBLE)::BIGINT"
