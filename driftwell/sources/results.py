"""Stored scores (nested JSON) and result tables (CSV per domain)."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.utils import AnalysisException

log = logging.getLogger(__name__)

SCORE_MAP = "map<string,map<string,array<double>>>"
CALIBRATION_MAP = "map<string,array<double>>"
METRICS_SCHEMA = (
    "detector string, alpha double, TPR double, FPR double, Precision double, F1 double, mean_score double, "
    "std_score double, TNR double, AUC_TPR double, `alpha@80%TPR` double, `TPR@alpha=0.5` double, AUC_ROC double"
)


def scores_as_json(scores: DataFrame) -> DataFrame:
    """(value): one JSON line per detector and intensity, {detector: {alpha: [score of run 0, 1, ...]}}.

    An array holds one intensity's runs; it does not grow with the scored tables.
    """
    runs = scores.groupBy("detector", "alpha").agg(F.sort_array(F.collect_list(F.struct("run", "score"))).alias("r"))
    grid = F.create_map(F.col("alpha").cast("double").cast("string"), F.col("r.score"))
    return runs.select(F.to_json(F.create_map(F.col("detector"), grid)).alias("value"))


def calibration_as_json(calibration: DataFrame) -> DataFrame:
    """(value): one JSON line per detector, {detector: [score of held-out run 0, 1, ...]}."""
    runs = calibration.groupBy("detector").agg(F.sort_array(F.collect_list(F.struct("run", "score"))).alias("r"))
    return runs.select(F.to_json(F.create_map(F.col("detector"), F.col("r.score"))).alias("value"))


def write_calibration_json(calibration: DataFrame, path: str) -> None:
    calibration_as_json(calibration).write.mode("overwrite").text(path)


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(document) of files that hold one or more JSON objects, each over one or more lines; text
    that is no such object is an error."""
    parts = F.explode(F.split("value", r"(?<=\})\s*\n(?=\{)")).alias("value")
    found = spark.read.text(path, wholetext=True).select(parts).filter("trim(value) <> ''")
    wrong = F.raise_error(F.concat(F.lit("not a score document: "), F.substring("value", 1, 80)))
    return found.select(F.coalesce(F.from_json("value", schema), wrong.cast(schema)).alias("document"))


def write_scores_json(scores: DataFrame, path: str) -> None:
    scores_as_json(scores).write.mode("overwrite").text(path)


def read_scores_json(spark: SparkSession, path: str) -> DataFrame:
    """(detector, alpha, run, score) of one or more files; the text keys become numbers
    and the run is the position in the array."""
    return (
        _documents(spark, path, SCORE_MAP)
        .select(F.explode("document").alias("detector", "grid"))
        .select("detector", F.explode("grid").alias("alpha", "runs"))
        .select("detector", F.col("alpha").cast("decimal(6,4)").alias("alpha"), F.posexplode("runs").alias("run", "score"))
    )


def read_calibration_json(spark: SparkSession, path: str) -> DataFrame:
    """(detector, run, score) of {detector: [score, ...]}."""
    return (
        _documents(spark, path, CALIBRATION_MAP)
        .select(F.explode("document").alias("detector", "runs"))
        .select("detector", F.posexplode("runs").alias("run", "score"))
    )


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_domain_metrics(spark: SparkSession, folders: dict[str, str], *, schema: str = METRICS_SCHEMA) -> DataFrame:
    """Metrics of several result folders with a ``domain`` column. Columns go by their header
    names, in any order; one that a file lacks is null. A missing folder is left out with a warning."""
    found = []
    fields = _parse_datatype_string(schema).fields
    for domain, path in folders.items():
        try:
            raw = spark.read.option("header", True).csv(path)
            table = raw.select(
                *[(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
            )
        except AnalysisException:
            log.warning("no metrics for %s at %s", domain, path)
            continue
        found.append(table.withColumn("domain", F.lit(domain)))
    if not found:
        raise ValueError("no metrics in any folder")
    out = found[0]
    for t in found[1:]:
        out = out.unionByName(t)
    return out
