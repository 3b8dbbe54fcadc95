"""Filling, checking and repairing columns that should equal ``a op b``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gristmill.functions.formulas import formula_rounded, formula_value
from gristmill.functions.moments import share
from gristmill.functions.types import (
    MutationResult,
    col,
    is_integer,
    replace_columns,
    require_numeric,
    require_order,
)

SAMPLE_ROWS = 5


def _computed(df: DataFrame, target: str, formula: str, a: str, b: str) -> Column:
    """The formula's value in the type of the target column."""
    value = formula_rounded(formula, col(a), col(b))
    if is_integer(df.schema[target]):
        value = F.rint(formula_value(formula, col(a), col(b)))
    return value.cast(df.schema[target].dataType)


def fill_derived(df: DataFrame, target: str, formula: str, a: str, b: str) -> MutationResult:
    """Fill a missing target wherever both operands allow computing it."""
    require_numeric(df, [target, a, b])
    value = _computed(df, target, formula, a, b)
    fillable = col(target).isNull() & value.isNotNull()
    filled = replace_columns(df, {target: F.coalesce(col(target), value)})
    return MutationResult(filled, df.agg(F.count_if(fillable).alias("cells_filled")))


def _differences(df: DataFrame, result: str, formula: str, a: str, b: str, tolerance: float):
    if tolerance is None or tolerance <= 0:
        raise ValueError("tolerance must be greater than 0")
    require_numeric(df, [result, a, b])
    calc = formula_value(formula, col(a), col(b))
    return calc, F.abs(calc - col(result))


def validate_formula(
    df: DataFrame, result: str, formula: str, a: str, b: str, tolerance: float = 0.01
) -> DataFrame:
    """One row: rows in the table, rows checked, rows off by more than the tolerance."""
    _, diff = _differences(df, result, formula, a, b, tolerance)
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(diff).alias("checked_rows"),
        F.count_if(diff > tolerance).alias("error_count"),
    )
    return counts.withColumn("error_pct", share(F.col("error_count"), F.col("checked_rows"), 1))


def formula_error_sample(
    df: DataFrame,
    result: str,
    formula: str,
    a: str,
    b: str,
    order_by,
    tolerance: float = 0.01,
    limit: int = SAMPLE_ROWS,
) -> DataFrame:
    """The first offending rows in key order with the expected value."""
    keys = require_order(df, order_by)
    calc, diff = _differences(df, result, formula, a, b, tolerance)
    shown = list(dict.fromkeys([*keys, a, b, result]))
    return (
        df.filter(diff > tolerance)
        .orderBy(*[col(k) for k in keys])
        .limit(limit)
        .select(
            *[col(c) for c in shown],
            F.round(calc, 4).alias("calculated"),
            F.round(diff, 4).alias("difference"),
        )
    )


def fix_formula(
    df: DataFrame, target: str, formula: str, a: str, b: str, tolerance: float = 0.01
) -> MutationResult:
    """Overwrite only the targets that are off by more than the tolerance."""
    _, diff = _differences(df, target, formula, a, b, tolerance)
    value = _computed(df, target, formula, a, b)
    fixed = replace_columns(
        df, {target: F.when(diff > tolerance, value).otherwise(col(target))}
    )
    return MutationResult(fixed, df.agg(F.count_if(diff > tolerance).alias("cells_fixed")))
