"""Bootstrap resamples with a controlled shift, kept as row weights.

A resample only repeats pool rows, so it is stored as the number of times each
row was drawn. The draws of a run do not depend on the shift intensity: run r
draws once, and intensity alpha takes the first n_g(alpha) draws of group g.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions.hashing import index_draw
from driftwell.operators.numbering import bucket_counts, number_rows
from driftwell.session import cut_lineage

ALPHA_TYPE = "decimal(6,4)"
WHOLE_POOL = "all"


def alpha_key(alpha: float) -> Decimal:
    """Shift intensity as an exact key."""
    if not 0.0 <= float(alpha) <= 1.0:
        raise ValueError(f"alpha must be in [0, 1], got {alpha}")
    key = Decimal(str(alpha)).quantize(Decimal("0.0001"))
    if key != Decimal(str(alpha)):
        raise ValueError(f"alpha has at most four decimals, got {alpha}")
    return key


def mixture_counts(sizes: dict[str, int], alphas: list[float]) -> dict[str, list[int]]:
    """Rows to draw from class ``a`` and ``b`` for every alpha.

    The share of ``b`` is alpha, rounded half to even; a pool that lacks one of
    the classes is resampled as a whole.
    """
    n = sum(sizes.values())
    if not sizes.get("a") or not sizes.get("b"):
        return {WHOLE_POOL: [n] * len(alphas)}
    from_b = [round(a * n) for a in alphas]
    return {"a": [n - k for k in from_b], "b": from_b}


def subgroup_counts(sizes: dict[str, int], alphas: list[float]) -> dict[str, list[int]]:
    """Rows to draw from the subgroup (``b``) and the others (``a``) for every alpha.

    The subgroup's share moves linearly from its share in the pool to 1.
    """
    n = sum(sizes.values())
    if not sizes.get("b"):
        return {WHOLE_POOL: [n] * len(alphas)}
    base = sizes["b"] / n
    inside = [round((base + a * (1.0 - base)) * n) for a in alphas]
    return {"a": [n - k for k in inside], "b": inside}


def _per_group(values: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {value}L" for name, value in values.items())
    return f"(CASE grp {cases} ELSE 0L END)"


def _draws(spark: SparkSession, sizes: dict[str, int], counts: dict[str, list[int]], n_runs: int, seed: int) -> DataFrame:
    """(draw, grp, run, rn): draw number i of run r in group g is the row with number floor(u * size_g), u being the
    hash of (seed + r, g, i)."""
    longest = {g: max(c) for g, c in counts.items()}
    return (
        spark.range(max(longest.values()))
        .withColumnRenamed("id", "draw")
        .withColumn("grp", F.explode(F.array(*[F.lit(g) for g in counts])))
        .filter(f"draw < {_per_group(longest)}")
        .withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))
        .withColumn("rn", index_draw(F.expr(_per_group(sizes)), F.col("run") + F.lit(seed), F.col("grp"), F.col("draw")))
    )


def draw_counts(
    numbered: DataFrame,
    sizes: dict[str, int],
    counts: dict[str, list[int]],
    *,
    n_runs: int,
    seed: int,
    row_id: str = "row_id",
) -> DataFrame:
    """(run, row_id, w0, w1, ...) for pool rows numbered within ``grp``: how often a run draws the row at each alpha.

    One shuffle carries one counter per alpha."""
    draws = _draws(numbered.sparkSession, sizes, counts, n_runs, seed)
    n_alphas = len(next(iter(counts.values())))
    taken = [
        F.expr(f"int(count_if(draw < {_per_group({g: c[i] for g, c in counts.items()})})) AS w{i}") for i in range(n_alphas)
    ]
    drawn = draws.groupBy("run", "grp", "rn").agg(*taken)
    return drawn.join(numbered.select(row_id, "grp", "rn"), ["grp", "rn"]).select(
        F.col("run").cast("int"), row_id, *[f"w{i}" for i in range(n_alphas)]
    )


def long_weights(counted: DataFrame, alphas: list[float]) -> DataFrame:
    """(alpha, run, other columns..., w) from counters ``w0, w1, ...`` of the alphas: one row for each that is not zero."""
    own = [f"w{i}" for i in range(len(alphas))]
    listed = ", ".join(f"struct(CAST({alpha_key(a)} AS {ALPHA_TYPE}) AS alpha, {w} AS w)" for a, w in zip(alphas, own, strict=True))
    others = [c for c in counted.columns if c not in (*own, "run")]
    return (
        counted.select("run", *others, F.explode(F.expr(f"array({listed})")).alias("z"))
        .select(F.col("z.alpha").alias("alpha"), "run", *others, F.col("z.w").alias("w"))
        .filter(F.col("w") > 0)
    )


def _counters(
    grouped: DataFrame,
    count_rule,
    alphas: list[float],
    n_runs: int,
    seed: int,
    row_id: str,
) -> DataFrame:
    rows = grouped.select(row_id, "grp")
    buckets = cut_lineage(bucket_counts(rows, row_id, ["grp"]))
    sizes = {r["grp"]: r["n"] for r in buckets.groupBy("grp").agg(F.sum("_n").alias("n")).collect()}
    counts = count_rule(sizes, alphas)
    if WHOLE_POOL in counts:
        rows = rows.withColumn("grp", F.lit(WHOLE_POOL))
        buckets = buckets.groupBy(F.lit(WHOLE_POOL).alias("grp"), "_bucket").agg(F.sum("_n").alias("_n"))
        sizes = {WHOLE_POOL: sum(sizes.values())}
    numbered = number_rows(rows, row_id, ["grp"], counts=buckets)
    return draw_counts(numbered, sizes, counts, n_runs=n_runs, seed=seed, row_id=row_id)


def _weights(
    grouped: DataFrame,
    count_rule,
    alphas: list[float],
    n_runs: int,
    seed: int,
    row_id: str,
) -> DataFrame:
    return long_weights(_counters(grouped, count_rule, alphas, n_runs, seed, row_id), alphas)


def class_mixture_weights(
    pool: DataFrame,
    label: str,
    class_a: object,
    class_b: object,
    alphas: list[float],
    *,
    n_runs: int,
    seed: int = 42,
    row_id: str = "row_id",
) -> DataFrame:
    """Resamples that mix two classes; rows of other classes are never drawn."""
    for a in alphas:
        alpha_key(a)
    grp = F.when(F.col(label) == class_a, "a").when(F.col(label) == class_b, "b").otherwise("other")
    grouped = pool.withColumn("grp", grp)

    return _weights(grouped, mixture_counts, alphas, n_runs, seed, row_id)


def subgroup_shift_weights(
    pool: DataFrame,
    in_subgroup: Column,
    alphas: list[float],
    *,
    n_runs: int,
    seed: int = 42,
    row_id: str = "row_id",
) -> DataFrame:
    """Resamples whose subgroup share grows with alpha; a null predicate means outside."""
    return long_weights(subgroup_shift_counters(pool, in_subgroup, alphas, n_runs=n_runs, seed=seed, row_id=row_id), alphas)


def subgroup_shift_counters(
    pool: DataFrame,
    in_subgroup: Column,
    alphas: list[float],
    *,
    n_runs: int,
    seed: int = 42,
    row_id: str = "row_id",
) -> DataFrame:
    """The same with a row for each run and counters of the alphas (see ``long_weights``), for callers that join them first."""
    for a in alphas:
        alpha_key(a)
    inside = F.coalesce(in_subgroup, F.lit(False))
    grouped = pool.withColumn("grp", F.when(inside, "b").otherwise("a"))
    return _counters(grouped, subgroup_counts, alphas, n_runs, seed, row_id)


def bootstrap_weights(
    pool: DataFrame, *, n_runs: int, seed: int = 42, row_id: str = "row_id"
) -> DataFrame:
    """(run, row_id, w): plain bootstrap of the whole pool."""
    grouped = pool.withColumn("grp", F.lit(WHOLE_POOL))

    def rule(sizes: dict[str, int], grid: list[float]) -> dict[str, list[int]]:
        return {WHOLE_POOL: [sum(sizes.values())]}

    return _weights(grouped, rule, [0.0], n_runs, seed, row_id).drop("alpha")
