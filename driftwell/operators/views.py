"""Row clean-up and the three feature views the detectors read."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

VARIANCE_FLOOR = 1e-8
FIRST_FEATURES = 50
MAX_CATEGORIES = 20_000


# ---- rows


def trim_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Strip blanks from the named string columns."""
    return df.select(*[F.trim(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null in any column."""
    return df.na.drop("any")


def keep_classes(df: DataFrame, label: str, classes: list) -> DataFrame:
    return df.filter(F.col(label).isin(list(classes)))


def in_subgroup(column: str, value: object) -> Column:
    """Subgroup predicate whose complement keeps nulls."""
    return F.coalesce(F.col(column) == F.lit(value), F.lit(False))


def numeric_columns(df: DataFrame, *, without: list[str] | None = None) -> list[str]:
    skip = set(without or [])
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skip]


def other_columns(df: DataFrame, *, without: list[str] | None = None) -> list[str]:
    skip = set(without or [])
    return [f.name for f in df.schema if not isinstance(f.dataType, NumericType) and f.name not in skip]


# ---- one-hot encoding


def learn_categories(df: DataFrame, columns: list[str], *, limit: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted categories of every column. They become vector positions, so their number
    is checked before it is used."""
    melted = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("z")
    ).select("z.*")
    found = melted.filter("value IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} categories")
    return {c: sorted(r["value"] for r in found if r["column"] == c) for c in columns}


def one_hot(df: DataFrame, row_id: str, numeric: list[str], categories: dict[str, list[str]]) -> DataFrame:
    """(row_id, v): unscaled numeric columns, then one 0/1 block per categorical column;
    an unknown category gives zeros."""
    blocks = [F.array(*[F.col(c).cast("float") for c in numeric])] if numeric else []
    for column, known in categories.items():
        blocks.append(_flags(F.col(column).cast("string"), known))
    return df.select(F.col(row_id).alias("row_id"), F.concat(*blocks).alias("v"))


def _flags(value: Column, known: list[str]) -> Column:
    """0/1 for each known category: one expression over a literal array, however many there are."""
    names = F.lit(known) if known else F.array().cast("array<string>")
    return F.transform(names, lambda k: F.coalesce(value == k, F.lit(False)).cast("float"))


# ---- vectors


def feature_variances(df: DataFrame) -> DataFrame:
    """(pos, variance): population variance of every vector position."""
    melted = df.select(F.posexplode("v").alias("pos", "value"))
    return melted.groupBy("pos").agg(F.var_pop(F.col("value").cast("double")).alias("variance"))


def varying_positions(df: DataFrame, *, floor: float = VARIANCE_FLOOR) -> list[int]:
    """Positions whose variance exceeds the floor; at most the vector width."""
    kept = feature_variances(df).filter(F.col("variance") > floor).select("pos").collect()
    return sorted(r["pos"] for r in kept)


def keep_positions(df: DataFrame, positions: list[int]) -> DataFrame:
    """Vectors cut down to some positions, in their old order."""
    return df.withColumn("v", F.filter("v", lambda x, i: i.isin(list(positions))))


def first_features(df: DataFrame, n: int = FIRST_FEATURES) -> DataFrame:
    return df.withColumn("v", F.slice("v", 1, n))


def as_columns(df: DataFrame, n: int, *, prefix: str = "f") -> DataFrame:
    """(row_id, f0 .. f{n-1})."""
    return df.select("row_id", *[F.col("v")[i].alias(f"{prefix}{i}") for i in range(n)])


def vector_width(df: DataFrame) -> int:
    return df.agg(F.max(F.size("v"))).first()[0] or 0


def pca_views(reference: DataFrame, pool: DataFrame, n_components: int) -> tuple[DataFrame, DataFrame]:
    """Both sides on the reference's leading principal components, at most
    min(components, width, reference rows). Rows are rotated without centring, which
    leaves every distance as it is."""
    size = reference.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    k = min(n_components, size["d"], size["n"])

    def as_vector(df: DataFrame) -> DataFrame:
        return df.select("row_id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))

    model = PCA(k=k, inputCol="features", outputCol="projected").fit(as_vector(reference))
    return tuple(
        model.transform(as_vector(df)).select("row_id", vector_to_array("projected").alias("v"))
        for df in (reference, pool)
    )
