"""Headerless delimited files and labelled vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from driftwell.operators.views import drop_incomplete, trim_columns

# The census table's column names.
CENSUS_COLUMNS = [
    "age", "workclass", "fnlwgt", "education", "education_num", "marital_status", "occupation",
    "relationship", "race", "sex", "capital_gain", "capital_loss", "hours_per_week", "native_country", "income",
]
CENSUS_NUMERIC = ["age", "fnlwgt", "education_num", "capital_gain", "capital_loss", "hours_per_week"]
CENSUS_SCHEMA = StructType(
    [StructField(c, DoubleType() if c in CENSUS_NUMERIC else StringType()) for c in CENSUS_COLUMNS]
)


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, *, null: str = "?") -> DataFrame:
    """Scan without header; leading blanks are skipped, ``null`` and empty fields are null."""
    return (
        spark.read.schema(schema)
        .option("header", False)
        .option("ignoreLeadingWhiteSpace", True)
        .option("nullValue", null)
        .option("emptyValue", None)
        .csv(path)
    )


def clean_rows(df: DataFrame) -> DataFrame:
    """Trim strings, read blanks as null and drop incomplete rows."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    trimmed = trim_columns(df, strings)
    return drop_incomplete(
        trimmed.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in strings else F.col(c) for c in df.columns])
    )


def read_census(spark: SparkSession, path: str) -> DataFrame:
    """The census table, cleaned."""
    return clean_rows(read_delimited(spark, path, CENSUS_SCHEMA))


def read_vectors(spark: SparkSession, path: str, *, row_id: str, vector: str, label: str) -> DataFrame:
    """(row_id, v, label) of a parquet table of labelled vectors."""
    return spark.read.parquet(path).select(
        F.col(row_id).alias("row_id"), F.col(vector).cast("array<float>").alias("v"), F.col(label).alias("label")
    )
