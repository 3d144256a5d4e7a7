"""Per-column two-sample tests and the share of drifted columns.

All columns and all resamples go through one melted table of counts by (column,
value): equal values are added up before anything is sorted or joined, so a value that
a third of the rows share is one row here.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.stats import chi_square_p, kolmogorov_p, normal_two_sided_p
from driftwell.operators.detectors import unit_weights, weight_columns, weight_keys
from driftwell.operators.ordered import running_totals
from driftwell.operators.pairs import spread
from driftwell.operators.resample import ALPHA_TYPE, alpha_key
from driftwell.operators.views import numeric_columns
from driftwell.session import cut_lineage

FAMILIES = ("distance", "test")
FEW_VALUES = 5
MANY_VALUES = 50
P_LEVEL = 0.05
DISTANCE_LEVEL = 0.1
MIN_SPREAD = 1e-3
SLOTS = 8


def melted(df: DataFrame, columns: list[str], kind: str, *, keep: list[str] | None = None) -> DataFrame:
    """(keep..., column, value) without nulls; ``kind`` is the type of ``value``. A row carries its plain values to the
    explode, names are looked up after it."""
    return _named(df, columns, [F.col(c).cast(kind) for c in columns], keep or [])


def _named(df: DataFrame, columns: list[str], values: list[Column], keep: list[str]) -> DataFrame:
    long = df.select(*keep, F.posexplode(F.array(*values)).alias("_at", "value")).filter("value IS NOT NULL")
    return long.select(*keep, F.get(F.lit(columns), F.col("_at")).alias("column"), "value")


def value_counts(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    return melted(df, columns, kind).groupBy("column", "value").agg(F.count("*").alias("n"))


def _slots(n: int) -> list[str]:
    return [f"t{i}" for i in range(n)]


@dataclass(frozen=True)
class Drawn:
    """Pool rows with their weights: one row holds those of up to ``SLOTS`` resamples, so the
    values are melted, shuffled and sorted once per chunk of resamples."""

    rows: DataFrame  # (chunk, t0, t1, ..., pool columns)
    grid: DataFrame  # (keys..., chunk, slot)
    width: int
    chunks: int


def drawn_rows(pool: DataFrame, weights: DataFrame, columns: list[str]) -> Drawn:
    """The join of weights and pool; where several statistics read it, cut its lineage."""
    grid, n = weight_columns(weights)
    width = min(n, SLOTS)
    place = [(F.col("col") / width).cast("int").alias("chunk"), F.pmod(F.col("col"), F.lit(width)).alias("slot")]
    wide = (
        weights.join(F.broadcast(grid), weight_keys(weights))
        .select("row_id", "w", *place)
        .groupBy("row_id", "chunk")
        .agg(*[F.expr(f"sum(if(slot = {i}, w, 0)) AS {s}") for i, s in enumerate(_slots(width))])
    )
    rows = wide.join(pool.select("row_id", *columns), "row_id").drop("row_id")
    return Drawn(rows, grid.select(*weight_keys(weights), *place), width, (n - 1) // width + 1)


def drawn_counters(pool: DataFrame, counters: DataFrame, alphas: list[float], n_runs: int, columns: list[str]) -> Drawn:
    """The join of pool and resample counters (run, row_id, w0, w1, ...) as drawn: a run's counters fill their slots of a
    chunk, so they are neither made long nor grouped again."""
    n = len(alphas)
    runs = max(1, min(n_runs, SLOTS // n))
    slots = [F.expr(f"if(run % {runs} = {i // n}, bigint(w{i % n}), 0L) AS {s}") for i, s in enumerate(_slots(runs * n))]
    placed = counters.select("row_id", F.floor(F.col("run") / runs).cast("int").alias("chunk"), *slots)
    cells = [(alpha_key(a), run, run // runs, run % runs * n + i) for run in range(n_runs) for i, a in enumerate(alphas)]
    grid = pool.sparkSession.createDataFrame(cells, f"alpha {ALPHA_TYPE}, run int, chunk int, slot int")
    rows = placed.join(pool.select("row_id", *columns), "row_id").drop("row_id")
    return Drawn(rows, grid, runs * n, (n_runs - 1) // runs + 1)


def both_counts(reference: DataFrame, drawn: Drawn, columns: list[str], kind: str) -> DataFrame:
    """Counts of both sides by value: (chunk, column, value, r, t0, t1, ...)."""
    slots, zero = _slots(drawn.width), F.lit(0).cast("bigint")
    theirs = (
        melted(drawn.rows, columns, kind, keep=["chunk", *slots])
        .groupBy("chunk", "column", "value")
        .agg(*[F.expr(f"sum({s}) AS {s}") for s in slots])
        .withColumn("r", zero)
    )
    ours = value_counts(reference, columns, kind).select(
        spread(0, drawn.chunks - 1).alias("chunk"), "column", "value", *[zero.alias(s) for s in slots], F.col("n").alias("r")
    )
    return ours.unionByName(theirs)


def _by_resample(found: DataFrame, grid: DataFrame, parts: list[str]) -> DataFrame:
    """(keys..., column, statistics...) from one row per (chunk, column) with one struct
    of statistics per slot."""
    long = found.select("chunk", "column", F.posexplode(F.expr(f"array({', '.join(parts)})")).alias("slot", "s"))
    return long.join(F.broadcast(grid), ["chunk", "slot"]).select(
        *[c for c in grid.columns if c not in ("chunk", "slot")], "column", "s.*"
    )


def _drawn(pool: DataFrame, weights: DataFrame | Drawn | None, columns: list[str]) -> Drawn:
    """``weights``: resample weights, one row each by default, or their join with the pool."""
    if isinstance(weights, Drawn):
        return weights
    return drawn_rows(pool, unit_weights(pool) if weights is None else weights, columns)


def _grid_keys(drawn: Drawn) -> list[str]:
    return weight_keys(drawn.grid.drop("chunk", "slot"))


def numeric_statistics(
    reference: DataFrame, pool: DataFrame, columns: list[str], weights: DataFrame | Drawn | None = None
) -> DataFrame:
    """(keys..., column, ks, ks_p, wasserstein) of numeric columns from one pass.

    ks is the largest gap of the two distribution functions, wasserstein the area
    between them over the reference's standard deviation.
    """
    drawn = _drawn(pool, weights, columns)
    counts, grid, slots = both_counts(reference, drawn, columns, "double"), drawn.grid, _slots(drawn.width)
    steps = running_totals(counts, ["chunk", "column"], "value", ["r", *slots], following=True)
    step = "coalesce(following - value, 0.0D)"

    def gap(t: str) -> str:
        # the last chunk may have unused slots, whose totals are zero
        return f"abs(try_divide(r_before + r, r_all) - try_divide({t}_before + {t}, {t}_all))"

    found = steps.groupBy("chunk", "column").agg(
        F.expr("max(r_all) AS r_all"),
        *[F.expr(f"max({t}_all) AS {t}_all") for t in slots],
        *[F.expr(f"max({gap(t)}) AS {t}_ks") for t in slots],
        *[F.expr(f"sum({gap(t)} * {step}) AS {t}_area") for t in slots],
    )
    spreads = melted(reference, columns, "double").groupBy("column").agg(F.stddev_pop("value").alias("sd"))
    long = _by_resample(
        found,
        grid,
        [f"struct({t}_ks AS ks, {t}_area AS area, r_all AS n, {t}_all AS m)" for t in slots],
    )
    return long.join(F.broadcast(spreads), "column").select(  # one row per column of the schema
        *_grid_keys(drawn),
        "column",
        "ks",
        kolmogorov_p(F.col("ks"), F.col("n"), F.col("m")).alias("ks_p"),
        (F.col("area") / F.greatest("sd", F.lit(MIN_SPREAD))).alias("wasserstein"),
    )


def categorical_statistics(
    reference: DataFrame, pool: DataFrame, columns: list[str], weights: DataFrame | Drawn | None = None
) -> DataFrame:
    """(keys..., column, js, chi_square, df, z) of categorical columns from one pass.

    js is the Jensen-Shannon distance of category shares in bits; chi_square compares
    test counts with reference shares; z is the pooled two-proportion statistic of the
    first of two categories, null for more than two.
    """
    drawn = _drawn(pool, weights, columns)
    counts, grid, slots = both_counts(reference, drawn, columns, "string"), drawn.grid, _slots(drawn.width)
    keys = ["chunk", "column"]
    sums = ["r", *slots]
    counts = counts.groupBy(*keys, "value").agg(*[F.expr(f"sum({c}) AS {c}") for c in sums])
    totals = counts.groupBy(*keys).agg(*[F.expr(f"sum({c}) AS {c}_all") for c in sums])

    def statistics(t: str) -> list[Column]:
        # the last chunk may have unused slots, whose totals are zero
        p, q = "try_divide(r, r_all)", f"try_divide({t}, {t}_all)"
        mid, expected, present = f"(({p} + {q}) / 2)", f"({p} * {t}_all)", f"(r > 0 OR {t} > 0)"
        bits = f"if(r > 0, {p} * log2({p} / {mid}), 0.0D) + if({t} > 0, {q} * log2({q} / {mid}), 0.0D)"
        unseen = f"if({t} > 0, double('infinity'), 0.0D)"
        off = f"try_divide(({t} - {expected}) * ({t} - {expected}), {expected})"
        return [
            F.expr(f"sqrt(greatest(sum(({bits}) / 2), 0.0D)) AS {t}_js"),
            F.expr(f"sum(if(r > 0, {off}, {unseen})) AS {t}_chi"),
            F.expr(f"count_if({present}) - 1 AS {t}_df"),
            F.expr(f"min(if({present}, struct(value, r AS r, {t} AS t), NULL)) AS {t}_first"),
            F.expr(f"max({t}_all) AS {t}_m"),
        ]

    found = (
        counts.join(totals, keys)
        .groupBy(*keys)
        .agg(F.expr("max(r_all) AS n"), *[c for t in slots for c in statistics(t)])
    )
    long = _by_resample(
        found,
        grid,
        [
            f"struct({t}_js AS js, {t}_chi AS chi_square, {t}_df AS df, double({t}_first.r) AS a, "
            f"double({t}_first.t) AS b, double(n) AS n, double({t}_m) AS m)"
            for t in slots
        ],
    )
    a, b, n, m = (F.col(c) for c in "abnm")
    pooled = (a + b) / (n + m)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    z = F.coalesce((a / n - b / m) / F.when(error > 0, error), F.lit(0.0))
    return long.select(
        *_grid_keys(drawn), "column", "js", "chi_square", "df", F.when(F.col("df") <= 1, z).alias("z")
    )


def ks_by_column(reference: DataFrame, pool: DataFrame, columns: list[str], weights: DataFrame | Drawn | None = None) -> DataFrame:
    """(keys..., column, statistic, p_value) of the Kolmogorov-Smirnov test."""
    found = numeric_statistics(reference, pool, columns, weights)
    return found.withColumnsRenamed({"ks": "statistic", "ks_p": "p_value"}).drop("wasserstein")


def wasserstein_by_column(
    reference: DataFrame, pool: DataFrame, columns: list[str], weights: DataFrame | Drawn | None = None
) -> DataFrame:
    """(keys..., column, statistic): normalised Wasserstein distance."""
    return numeric_statistics(reference, pool, columns, weights).withColumnRenamed("wasserstein", "statistic").drop("ks", "ks_p")


def jensen_shannon_by_column(
    reference: DataFrame, pool: DataFrame, columns: list[str], weights: DataFrame | Drawn | None = None
) -> DataFrame:
    """(keys..., column, statistic): Jensen-Shannon distance."""
    found = categorical_statistics(reference, pool, columns, weights)
    return found.withColumnRenamed("js", "statistic").drop("chi_square", "df", "z")


def chi_square_by_column(
    reference: DataFrame, pool: DataFrame, columns: list[str], weights: DataFrame | Drawn | None = None
) -> DataFrame:
    """(keys..., column, statistic, df, p_value) of the chi-square test."""
    found = categorical_statistics(reference, pool, columns, weights).withColumnRenamed("chi_square", "statistic")
    return found.drop("js", "z").withColumn("p_value", chi_square_p("statistic", "df"))


def proportion_z_by_column(
    reference: DataFrame, pool: DataFrame, columns: list[str], weights: DataFrame | Drawn | None = None
) -> DataFrame:
    """(keys..., column, statistic, p_value) of the two-proportion test, for columns with
    at most two categories."""
    found = categorical_statistics(reference, pool, columns, weights).filter(F.col("df") <= 1)
    return found.withColumnRenamed("z", "statistic").drop("js", "chi_square", "df").withColumn(
        "p_value", normal_two_sided_p("statistic")
    )


def _distinct_values(reference: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct values per column, exact where there are few.

    A sketch fed with few values holds few marks, so a large estimate proves that there
    are many; only the other columns are counted exactly. A sketch is a row of its own, not
    one of as many aggregates as there are columns.
    """
    marks = [F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in columns]
    sketch = _named(reference, columns, marks, []).groupBy("column").agg(F.approx_count_distinct("value").alias("k")).collect()
    distinct = dict.fromkeys(columns, 0) | {r["column"]: r["k"] for r in sketch}
    unsure = [c for c, k in distinct.items() if k <= MANY_VALUES]
    if unsure:
        exact = value_counts(reference, unsure, "string").groupBy("column").agg(F.count("*").alias("k")).collect()
        distinct.update({c: 0 for c in unsure} | {r["column"]: r["k"] for r in exact})
    return distinct


def column_drift(
    reference: DataFrame,
    pool: DataFrame,
    weights: DataFrame | Drawn | None = None,
    *,
    columns: list[str] | None = None,
    family: str = "distance",
    p_level: float = P_LEVEL,
    distance_level: float = DISTANCE_LEVEL,
) -> DataFrame:
    """(keys..., column, test, statistic, drifted) with the test chosen per column.

    Family ``test`` (meant for small references): Kolmogorov-Smirnov for numbers, z for two
    categories, chi-square for more, drifted below ``p_level``. ``distance``: Wasserstein for
    numbers, Jensen-Shannon for categories, drifted from ``distance_level`` on. Numeric
    columns with few distinct values count as categorical.
    """
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {FAMILIES}, got {family!r}")
    columns = columns or [c for c in reference.columns if c != "row_id"]
    numbers = [c for c in numeric_columns(reference) if c in columns]
    distinct = _distinct_values(reference, columns)
    numeric = [c for c in numbers if distinct[c] > FEW_VALUES]
    categorical = [c for c in columns if c not in numeric]
    drawn = _drawn(pool, weights, columns)
    keys = [*_grid_keys(drawn), "column"]
    small = family == "test"
    parts: list[DataFrame] = []
    if numeric and categorical:
        drawn = replace(drawn, rows=cut_lineage(drawn.rows))  # both kinds read it

    def add(found: DataFrame, test, statistic, drifted) -> None:
        parts.append(found.select(*keys, test.alias("test"), statistic.alias("statistic"), drifted.alias("drifted")))

    if numeric:
        found = numeric_statistics(reference, pool, numeric, drawn)
        if small:
            add(found, F.lit("ks"), F.col("ks"), F.col("ks_p") < p_level)
        else:
            add(found, F.lit("wasserstein"), F.col("wasserstein"), F.col("wasserstein") >= distance_level)
    if categorical:
        found = categorical_statistics(reference, pool, categorical, drawn)
        if small:
            tested = found.withColumn("_chi_p", chi_square_p("chi_square", "df")).withColumn(
                "_z_p", normal_two_sided_p(F.coalesce("z", F.lit(0.0)))
            )
            two = F.col("z").isNotNull()
            add(
                tested,
                F.when(two, "z").otherwise("chi_square"),
                F.when(two, F.col("z")).otherwise(F.col("chi_square")),
                F.when(two, F.col("_z_p") < p_level).otherwise(F.col("_chi_p") < p_level),
            )
        else:
            add(found, F.lit("jensen_shannon"), F.col("js"), F.col("js") >= distance_level)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drifted_share(reference: DataFrame, pool: DataFrame, weights: DataFrame | Drawn | None = None, **rule) -> DataFrame:
    """(keys..., score): share of drifted columns."""
    drift = column_drift(reference, pool, weights, **rule)
    return drift.groupBy(*weight_keys(drift.drop("column", "test", "statistic", "drifted"))).agg(F.avg(F.col("drifted").cast("double")).alias("score"))
