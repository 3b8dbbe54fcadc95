"""Outlier bounds, detection and treatment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from gristmill.functions.moments import share
from gristmill.functions.types import (
    MutationResult,
    as_list,
    col,
    is_integer,
    numeric_columns,
    replace_columns,
    require_choice,
    require_numeric,
    require_order,
    require_range,
)
from gristmill.plans.stats import attach, literal, most_frequent, quantiles, tidy

METHODS = ("iqr", "zscore")
IMPUTE = ("mean", "median", "mode")
SAMPLE_ROWS = 5


def default_threshold(method: str) -> float:
    return 3.0 if method == "zscore" else 1.5


@dataclass(frozen=True)
class Spread:
    """Location and outlier bounds of one column; None where it has no value."""

    lower: float | None
    upper: float | None
    mean: float | None
    std: float | None
    low: float | None
    high: float | None
    median: float | None = None


def _spreads(
    df: DataFrame, names: Sequence[str], method: str, threshold: float, median: bool, approx: bool
) -> list[Spread]:
    """Bounds of every column from one row of aggregates.

    The numbers become literals, so a filter on them reaches the scan and the statistics
    are computed once for the table and its report.
    """
    require_choice(method, METHODS, "method")
    require_range(threshold, 0, 10, "threshold", open_low=True)
    aggregates = []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        aggregates += [
            F.avg(c).alias(f"mean{i}"),
            F.stddev_samp(c).alias(f"std{i}"),
            F.min(c).alias(f"low{i}"),
            F.max(c).alias(f"high{i}"),
        ]
    row = df.agg(*aggregates).first()
    ps = ([0.25, 0.75] if method == "iqr" else []) + ([0.5] if median else [])
    q = quantiles(df, names, ps, approx) if ps else {}
    out = []
    for i in range(len(names)):
        mean, std = row[f"mean{i}"], row[f"std{i}"]
        lower = upper = None
        if mean is not None and method == "iqr":
            width = threshold * (q[i, 1] - q[i, 0])
            lower, upper = q[i, 0] - width, q[i, 1] + width
        elif mean is not None:
            width = threshold * (std or 0.0)
            lower, upper = mean - width, mean + width
        out.append(
            Spread(lower, upper, mean, std, row[f"low{i}"], row[f"high{i}"], q.get((i, len(ps) - 1)) if median else None)
        )
    return out


def _outlying(name: str, spread: Spread, method: str) -> Column:
    """True where the value lies strictly outside its bounds; null is no outlier."""
    if spread.lower is None or (method == "zscore" and not spread.std):
        return F.lit(False)
    c = col(name).cast("double")
    return F.coalesce((c < spread.lower) | (c > spread.upper), F.lit(False))


def _counts(df: DataFrame, names, spreads, method: str) -> DataFrame:
    """One row: rows in the table and outliers per column."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(_outlying(n, s, method)).alias(f"out{i}")
            for i, (n, s) in enumerate(zip(names, spreads))
        ],
    )


def _four(value) -> Column:
    return F.round(literal(value), 4)


def outlier_bounds(
    df: DataFrame, columns, method: str = "iqr", threshold: float = 1.5, approx: bool = False
) -> DataFrame:
    """Rows ``(column, lower_bound, upper_bound)``."""
    names = require_numeric(df, as_list(columns))
    spreads = _spreads(df, names, method, threshold, False, approx)
    return df.sparkSession.createDataFrame(
        [(n, s.lower, s.upper) for n, s in zip(names, spreads)],
        "column string, lower_bound double, upper_bound double",
    )


def detect_outliers(
    df: DataFrame, columns, method: str = "iqr", threshold: float | None = None, approx: bool = False
) -> DataFrame:
    """Per column: outlier count and share of all rows, bounds and location statistics."""
    names = require_numeric(df, as_list(columns))
    threshold = default_threshold(method) if threshold is None else threshold
    spreads = _spreads(df, names, method, threshold, True, approx)
    return tidy(
        _counts(df, names, spreads, method),
        [
            {
                "column": F.lit(n),
                "outlier_count": F.col(f"out{i}"),
                "outlier_pct": share(F.col(f"out{i}"), F.col("total"), 1),
                "lower_bound": _four(s.lower),
                "upper_bound": _four(s.upper),
                "min": _four(s.low),
                "max": _four(s.high),
                "mean": _four(s.mean),
                "median": _four(s.median),
            }
            for i, (n, s) in enumerate(zip(names, spreads))
        ],
    )


def outlier_sample(
    df: DataFrame,
    columns,
    order_by,
    method: str = "iqr",
    threshold: float | None = None,
    limit: int = SAMPLE_ROWS,
) -> DataFrame:
    """The first outlying rows of each column in key order."""
    names = require_numeric(df, as_list(columns))
    keys = require_order(df, order_by)
    threshold = default_threshold(method) if threshold is None else threshold
    spreads = _spreads(df, names, method, threshold, False, False)
    entries = F.array(
        *[
            F.when(
                _outlying(n, s, method),
                F.struct(F.lit(n).alias("column"), col(n).cast("double").alias("value")),
            )
            for n, s in zip(names, spreads)
        ]
    )
    found = df.select(*[col(k) for k in keys], F.inline(F.array_compact(entries)))
    first = Window.partitionBy("column").orderBy(*[col(k) for k in keys])
    return (
        found.withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= limit)
        .select("column", *[col(k) for k in keys], "value", F.col("rank").cast("long").alias("rank"))
    )


def trim_outliers(
    df: DataFrame, columns, method: str = "iqr", threshold: float = 1.5, approx: bool = False
) -> DataFrame:
    """Drop the rows that are outlying in any column; nulls are no outliers."""
    names = require_numeric(df, as_list(columns))
    spreads = _spreads(df, names, method, threshold, False, approx)
    kept = df
    for n, s in zip(names, spreads):
        kept = kept.filter(~_outlying(n, s, method))
    return kept


def impute_outliers(
    df: DataFrame,
    columns,
    strategy: str = "mean",
    method: str = "iqr",
    threshold: float = 1.5,
    approx: bool = False,
) -> MutationResult:
    """Replace outliers by the column's mean, median or mode over all valid values."""
    require_choice(strategy, IMPUTE, "strategy")
    names = require_numeric(df, as_list(columns))
    spreads = _spreads(df, names, method, threshold, strategy == "median", approx)
    marked, exprs = df, {}
    for i, (n, s) in enumerate(zip(names, spreads)):
        field = df.schema[n]
        if strategy == "mode":
            marked = attach(marked, most_frequent(df, n), f"__mode{i}")
            new = F.col(f"__mode{i}").getField("mode")
        else:
            new = literal(s.mean if strategy == "mean" else s.median)
            new = F.rint(new) if is_integer(field) else new
        exprs[n] = F.when(_outlying(n, s, method), new.cast(field.dataType)).otherwise(col(n))
    imputed = marked.select(*[exprs[c].alias(c) if c in exprs else col(c) for c in df.columns])
    metrics = tidy(
        _counts(df, names, spreads, method),
        [{"column": F.lit(n), "cells_imputed": F.col(f"out{i}")} for i, n in enumerate(names)],
    )
    return MutationResult(imputed, metrics)


def cap_outliers(
    df: DataFrame, columns, lower_pct: float = 5, upper_pct: float = 95, approx: bool = False
) -> MutationResult:
    """Clamp each column to its own percentiles; the result is double, nulls stay."""
    require_range(lower_pct, 0, 100, "lower_pct")
    require_range(upper_pct, 0, 100, "upper_pct")
    if lower_pct >= upper_pct:
        raise ValueError("lower_pct must be below upper_pct")
    names = require_numeric(df, as_list(columns))
    q = quantiles(df, names, [lower_pct / 100, upper_pct / 100], approx)
    exprs, moved = {}, []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        low, high = literal(q[i, 0]), literal(q[i, 1])
        exprs[n] = F.when(c < low, low).when(c > high, high).otherwise(c)
        moved.append(F.count_if((c < low) | (c > high)).alias(f"m{i}"))
    capped = replace_columns(df, exprs)
    metrics = tidy(
        df.agg(*moved),
        [{"column": F.lit(n), "cells_capped": F.col(f"m{i}")} for i, n in enumerate(names)],
    )
    return MutationResult(capped, metrics)


def _summarised(df, method, threshold, columns, approx):
    names = require_numeric(df, as_list(columns)) or numeric_columns(df)
    if not names:
        raise ValueError("the table has no numeric column")
    spreads = _spreads(df, names, method, threshold, False, approx)
    return names, spreads, _counts(df, names, spreads, method)


def outlier_summary(
    df: DataFrame, method: str = "iqr", threshold: float = 1.5, columns=None, approx: bool = False
) -> DataFrame:
    """Outlier report over all numeric columns."""
    names, spreads, counts = _summarised(df, method, threshold, columns, approx)
    return tidy(
        counts,
        [
            {
                "column": F.lit(n),
                "outlier_count": F.col(f"out{i}"),
                "outlier_pct": share(F.col(f"out{i}"), F.col("total"), 2),
                "lower_bound": _four(s.lower),
                "upper_bound": _four(s.upper),
                "mean": _four(s.mean),
                "std": _four(s.std),
            }
            for i, (n, s) in enumerate(zip(names, spreads))
        ],
    )


def outlier_summary_totals(
    df: DataFrame, method: str = "iqr", threshold: float = 1.5, columns=None, approx: bool = False
) -> DataFrame:
    """One row: columns checked, columns with outliers, outlier cells."""
    names, _, counts = _summarised(df, method, threshold, columns, approx)
    affected = cells = F.lit(0).cast("long")
    for i in range(len(names)):
        affected = affected + F.when(F.col(f"out{i}") > 0, 1).otherwise(0)
        cells = cells + F.col(f"out{i}")
    return counts.select(
        F.col("total").alias("total_rows"),
        F.lit(len(names)).cast("long").alias("numeric_columns_checked"),
        affected.alias("columns_with_outliers"),
        cells.alias("total_outlier_cells"),
    )
