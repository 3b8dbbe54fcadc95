"""Schema questions and parameter checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

LOGICAL_TYPE = "logical"


@dataclass(frozen=True)
class MutationResult:
    """A transformed table and a lazy one-row-per-column report of what changed."""

    df: DataFrame
    metrics: DataFrame


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_integer(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.IntegralType)


def is_float(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType))


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType))


def is_datetime(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f)]


def col(name: str) -> Column:
    """Reference a column whose name may hold dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_list(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def require_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return list(names)


def require_numeric(df: DataFrame, names: Sequence[str]) -> list[str]:
    require_columns(df, names)
    wrong = [n for n in names if not is_numeric(df.schema[n])]
    if wrong:
        raise ValueError(f"columns are not numeric: {wrong}")
    return list(names)


def require_text(df: DataFrame, names: Sequence[str]) -> list[str]:
    require_columns(df, names)
    wrong = [n for n in names if not is_text(df.schema[n])]
    if wrong:
        raise ValueError(f"columns are not text: {wrong}")
    return list(names)


def require_order(df: DataFrame, order_by) -> list[str]:
    keys = as_list(order_by)
    if not keys:
        raise ValueError("this operator depends on row order: pass order_by")
    return require_columns(df, keys)


def require_choice(value, choices, what: str):
    if value not in choices:
        raise ValueError(f"{what} must be one of {sorted(choices)}, got {value!r}")
    return value


def require_range(value, low, high, what: str, open_low: bool = False):
    if value is None or value > high or value < low or (open_low and value == low):
        raise ValueError(f"{what} must be between {low} and {high}, got {value!r}")
    return value


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing floats are null throughout the library; files may hold NaN."""
    return df.select(
        *[
            F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else col(f.name)
            for f in df.schema
        ]
    )


def replace_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """One projection that swaps some columns and keeps position and the rest."""
    return df.select(
        *[exprs[n].alias(n) if n in exprs else col(n) for n in df.columns]
    )
