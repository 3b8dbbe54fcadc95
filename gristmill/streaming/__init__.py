"""Operators that run on a streaming DataFrame, without state and without a watermark.

Row-wise operators are planned as they are. Operators that need statistics of a whole table take
them from a ``fitted.Fitted`` (or ``fitted.LabelCodes``) that was fitted on a table before. What
an operator reports about a table (cells changed, columns skipped) is not computed on a stream;
these functions return the DataFrame alone. A cast whose date format would have to be inferred
from the data is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from gristmill.operators import columns, formula, nulls, transforms
from gristmill.operators.columns import add_column, drop_columns, rename_column
from gristmill.operators.fitted import Fitted, LabelCodes, apply_all
from gristmill.operators.nulls import drop_nulls
from gristmill.operators.rows import filter_rows


def cast(df, targets, formats=None, **options):
    """``columns.cast`` for a stream: datetimes of text columns need ``formats``."""
    unclear = [
        c for c, t in targets.items()
        if t == "datetime" and df.schema[c].dataType.typeName() == "string" and not formats
    ]
    if df.isStreaming and unclear:
        raise ValueError(f"a stream cannot infer the date format of {unclear}: pass formats")
    return columns.cast(df, targets, formats=formats, **options)


def fill_constant(df: DataFrame, value, names=None) -> DataFrame:
    return nulls.fill_nulls(df, "constant", names, value=value).df


def replace_values(df: DataFrame, mapping, names=None, confirm_global: bool = False) -> DataFrame:
    return columns.replace_values(df, mapping, names, confirm_global).df


def clean_strings(df: DataFrame, names, operation: str) -> DataFrame:
    return transforms.clean_strings(df, names, operation).df


def fill_derived(df: DataFrame, target: str, rule: str, a: str, b: str) -> DataFrame:
    return formula.fill_derived(df, target, rule, a, b).df


def fix_formula(df: DataFrame, target: str, rule: str, a: str, b: str, tolerance: float = 0.01) -> DataFrame:
    return formula.fix_formula(df, target, rule, a, b, tolerance).df


def extract_datetime(df: DataFrame, column: str, features, formats=None) -> DataFrame:
    """Date parts of a date or timestamp column, or of a text column whose ``formats`` are given."""
    if df.isStreaming and df.schema[column].dataType.typeName() == "string" and not formats:
        raise ValueError(f"a stream cannot infer the date format of '{column}': pass formats")
    return transforms.extract_datetime(df, column, features, formats=formats)


def normalize_columns(df: DataFrame) -> DataFrame:
    return columns.normalize_columns(df)


def apply_fitted(df: DataFrame, *steps: Fitted | LabelCodes) -> DataFrame:
    """Fills, scaling, transforms, outlier bounds, caps and encodings with statistics of another table."""
    return apply_all(df, list(steps))


__all__ = [
    "add_column", "apply_fitted", "cast", "clean_strings", "drop_columns", "drop_nulls", "extract_datetime", "fill_constant",
    "fill_derived", "filter_rows", "fix_formula", "normalize_columns", "rename_column", "replace_values",
]
