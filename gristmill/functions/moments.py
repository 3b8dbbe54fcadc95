"""Aggregate expressions with the guards ANSI mode needs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are present; null for a constant."""
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(xs) * F.stddev_samp(ys)
    return F.try_divide(F.covar_samp(xs, ys), F.nullif(spread, F.lit(0.0)))


def skew_corrected(n: Column, skew: Column, spread: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant, null below three values."""
    n = n.cast("double")
    value = skew * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.when(spread == 0, F.lit(0.0)).otherwise(value))


def kurtosis_corrected(n: Column, kurt: Column, spread: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant, null below four values."""
    n = n.cast("double")
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)
    return F.when(n >= 4, F.when(spread == 0, F.lit(0.0)).otherwise(value))


def share(part: Column, total: Column, digits: int) -> Column:
    """Percentage of ``total``; 0 for an empty table."""
    value = F.try_divide(part * F.lit(100.0), total)
    return F.round(F.coalesce(value, F.lit(0.0)), digits)
