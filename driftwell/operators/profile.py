"""Table profiles: sizes, nulls, summaries, histograms, value counts, cross tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.columns import melted, value_counts
from driftwell.operators.ordered import exact_percentiles

BINS = 50
TOP = 10


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns)."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> DataFrame:
    """(column, type, non_null) of every column."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).alias("non_null"))
            for f in df.schema
        ]
    )
    return counts.select(F.explode(rows).alias("z")).select("z.*")


def head(df: DataFrame, order: list[str], n: int = TOP) -> DataFrame:
    return df.orderBy(*order).limit(n)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n_null) of the columns that have nulls."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in df.columns])
    return counts.select(F.explode(rows).alias("z")).select("z.*").filter("n_null > 0")


def null_percentage(df: DataFrame) -> DataFrame:
    """(null_percentage): null cells per row times 100, above 100 when rows lack several."""
    cells = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg((F.sum(cells) / F.count("*") * 100).alias("null_percentage"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, std, min, q1, median, q3, max) with exact quartiles."""
    long = melted(df, columns, "double")
    moments = long.groupBy("column").agg(
        F.count("*").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_percentiles(long, ["column"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(quartiles, "column")


def histogram(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """(column, bin, n, median): equal-width bins 1..bins, the last one closed."""
    long = melted(df, columns, "double")
    limits = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    counted = long.groupBy("column", "value").agg(F.count("*").alias("_n"))
    width = F.col("hi") - F.col("lo")
    place = F.when(
        width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / F.when(width > 0, width) * bins) + 1, F.lit(bins))
    ).otherwise(F.lit(1))
    binned = (
        counted.join(F.broadcast(limits), "column")  # one row per column of the schema
        .groupBy("column", place.cast("int").alias("bin"))
        .agg(F.sum("_n").alias("n"))
    )
    return binned.join(exact_percentiles(long, ["column"], "value", {"median": 0.5}), "column")


def top_values(df: DataFrame, columns: list[str], n: int = TOP) -> DataFrame:
    """(column, value, n, percentage) of the most frequent values; ties in value order."""
    counts = value_counts(df, columns, "string")
    totals = counts.groupBy("column").agg(F.sum("n").alias("_all"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    top = counts.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    return top.join(totals, "column").select(
        "column", "value", "n", F.round(F.col("n") / F.col("_all") * 100, 2).alias("percentage")
    )


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct), exact."""
    return value_counts(df, columns, "string").groupBy("column").agg(F.count("*").alias("n_distinct"))


def row_percentages(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, percentage): cross table normalised over each row value."""
    pairs = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    counts = pairs.groupBy(row, column).agg(F.count("*").alias("_n"))
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy(row)) * 100
    return counts.select(row, column, share.alias("percentage"))


def share_percentage(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """(candidate, percentage): share of the rows in each candidate subgroup."""
    shares = df.agg(
        *[(F.avg(F.coalesce(p, F.lit(False)).cast("double")) * 100).alias(name) for name, p in predicates.items()]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(f"`{n}`").alias("percentage")) for n in predicates])
    return shares.select(F.explode(rows).alias("z")).select("z.*")
