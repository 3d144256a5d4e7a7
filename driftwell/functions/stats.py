"""Closed-form statistics as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed values.
NORMAL_975 = 1.959963984540054
KOLMOGOROV_TERMS = 100
PMF_SLACK = 1e-7


def wilson_bounds(hits: Column, n: Column, z: float = NORMAL_975) -> tuple[Column, Column]:
    """Wilson score interval of a share."""
    n = n.cast("double")
    p = hits.cast("double") / n
    z2 = F.lit(z * z)
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def binomial_log_pmf(n: Column, p0: float) -> Column:
    """Array of ln P(X = k), k = 0..n, for X ~ Binomial(n, p0).

    ln C(n, k) is a running sum of ln((n - i + 1) / i)."""
    log_choose = F.aggregate(
        F.sequence(F.lit(1), n),
        F.array(F.lit(0.0)),
        lambda acc, i: F.concat(
            acc, F.array(F.element_at(acc, -1) + F.log((n - i + 1).cast("double") / i.cast("double")))
        ),
    )
    return F.transform(
        F.when(n > 0, log_choose).otherwise(F.array(F.lit(0.0))),
        lambda c, k: c + k * F.lit(math.log(p0)) + (n - k) * F.lit(math.log1p(-p0)),
    )


def binomial_two_sided(hits: Column, n: Column, p0: float) -> Column:
    """Exact two-sided p-value: total chance of outcomes no likelier than the one seen."""
    n, hits = n.cast("int"), hits.cast("int")
    pmf = F.transform(binomial_log_pmf(n, p0), lambda x: F.exp(x))
    seen = F.element_at(pmf, hits + 1) * F.lit(1.0 + PMF_SLACK)
    tail = F.aggregate(
        pmf, F.lit(0.0), lambda acc, x: acc + F.when(x <= seen, x).otherwise(F.lit(0.0))
    )
    return F.least(tail, F.lit(1.0))


def kolmogorov_p(distance: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    n, m = n.cast("double"), m.cast("double")
    lam2 = distance * distance * n * m / (n + m)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * lam2),
    )
    return F.when(lam2 < 0.04, F.lit(1.0)).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0)))


def _chi_square_tail(x: float, df: int) -> float:
    """Upper tail of a chi-square with whole degrees of freedom: a finite sum."""
    if df <= 0 or x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    half = x / 2.0
    if df % 2 == 0:
        logs = [i * math.log(half) - math.lgamma(i + 1) - half for i in range(df // 2)]
        return min(1.0, math.fsum(map(math.exp, logs)))
    logs = [(i - 0.5) * math.log(half) - math.lgamma(i + 0.5) - half for i in range(1, (df + 1) // 2)]
    return min(1.0, math.erfc(math.sqrt(half)) + math.fsum(map(math.exp, logs)))


@F.pandas_udf(DoubleType())
def chi_square_p(statistic: pd.Series, df: pd.Series) -> pd.Series:
    """Upper-tail probability; runs on one row per tested column, never on data rows."""
    return pd.Series([_chi_square_tail(float(x), int(k)) for x, k in zip(statistic, df)])


@F.pandas_udf(DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|); runs on one row per tested column, never on data rows."""
    return pd.Series([math.erfc(abs(float(v)) / math.sqrt(2.0)) for v in z])
