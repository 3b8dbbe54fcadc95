"""Numeric transforms, scaling, text cleaning, date parts and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gristmill.functions.casts import to_timestamp
from gristmill.functions.text import strip, title, to_text
from gristmill.functions.types import (
    MutationResult,
    as_list,
    col,
    is_numeric,
    is_text,
    replace_columns,
    require_choice,
    require_columns,
    require_numeric,
    require_text,
)
from gristmill.operators.columns import FIRST, _with_first_values
from gristmill.plans.ordering import key_struct, with_row_number
from gristmill.plans.session import checkpoint, sized
from gristmill.plans.stats import attach, stat, tidy

TRANSFORMS = ("log", "sqrt", "cbrt")
SCALERS = ("minmax", "zscore")
TEXT_CLEANERS = ("strip", "lower", "upper", "title")
DATE_PARTS = ("year", "month", "day", "weekday", "hour", "minute")
ONEHOT_LIMIT = 15


def transform_columns(df: DataFrame, columns, function: str) -> MutationResult:
    """Element-wise transform; a column outside the function's domain is left as it is."""
    require_choice(function, TRANSFORMS, "function")
    names = require_numeric(df, as_list(columns))
    stats = df.agg(*[F.min(col(n)).alias(f"min{i}") for i, n in enumerate(names)])
    marked = attach(df, stats)
    exprs, rows = {}, []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        if function == "cbrt":
            exprs[n] = F.cbrt(c)
            blocked, reason = F.lit(False), ""
        elif function == "sqrt":
            exprs[n] = F.when(stat(f"min{i}") >= 0, F.sqrt(c)).otherwise(c)
            blocked, reason = F.col(f"min{i}") < 0, "contains negative values"
        else:
            exprs[n] = F.when(stat(f"min{i}") > 0, F.ln(c)).otherwise(c)
            blocked, reason = F.col(f"min{i}") <= 0, "contains zero or negative values"
        blocked = F.coalesce(blocked, F.lit(False))
        rows.append(
            {
                "column": F.lit(n),
                "skipped": blocked,
                "reason": F.when(blocked, reason),
            }
        )
    changed = marked.select(*[exprs[c].alias(c) if c in exprs else col(c) for c in df.columns])
    return MutationResult(changed, tidy(stats, rows))


def scale_columns(df: DataFrame, columns, method: str) -> MutationResult:
    """Min-max or z-score scaling; a column without spread is left as it is."""
    require_choice(method, SCALERS, "method")
    names = require_numeric(df, as_list(columns))
    aggregates = []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        if method == "minmax":
            aggregates += [F.min(c).alias(f"base{i}"), (F.max(c) - F.min(c)).alias(f"width{i}")]
        else:
            aggregates += [F.avg(c).alias(f"base{i}"), F.stddev_samp(c).alias(f"width{i}")]
    stats = df.agg(*aggregates)
    marked = attach(df, stats)
    exprs, rows = {}, []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        width = stat(f"width{i}")
        exprs[n] = F.when(width > 0, (c - stat(f"base{i}")) / width).otherwise(c)
        blocked = ~F.coalesce(F.col(f"width{i}") > 0, F.lit(False))
        rows.append(
            {
                "column": F.lit(n),
                "skipped": blocked,
                "reason": F.when(blocked, "all values are identical or missing"),
            }
        )
    changed = marked.select(*[exprs[c].alias(c) if c in exprs else col(c) for c in df.columns])
    return MutationResult(changed, tidy(stats, rows))


def clean_strings(df: DataFrame, columns, operation: str) -> MutationResult:
    """Text clean-up; reports the cells that changed."""
    require_choice(operation, TEXT_CLEANERS, "operation")
    names = require_text(df, as_list(columns))
    rule = {"strip": strip, "lower": F.lower, "upper": F.upper, "title": title}[operation]
    exprs = {n: rule(col(n)) for n in names}
    counts = df.agg(
        *[F.count_if(exprs[n] != col(n)).alias(f"n{i}") for i, n in enumerate(names)]
    )
    metrics = tidy(
        counts, [{"column": F.lit(n), "cells_changed": F.col(f"n{i}")} for i, n in enumerate(names)]
    )
    return MutationResult(replace_columns(df, exprs), metrics)


def extract_datetime(df: DataFrame, column: str, features, order_by=None, formats=None) -> DataFrame:
    """New columns ``{column}_{feature}``; Monday is weekday 0."""
    require_columns(df, [column])
    features = as_list(features)
    for f in features:
        require_choice(f, DATE_PARTS, "feature")
        if f"{column}_{f}" in df.columns:
            raise ValueError(f"column '{column}_{f}' already exists")
    field = df.schema[column]
    infer = is_text(field) and not formats
    prepared = _with_first_values(df, [column] if infer else [], order_by)
    first = F.col(FIRST).getField(column) if infer else None
    ts = to_timestamp(field, formats, first)
    part = {
        "year": F.year, "month": F.month, "day": F.day, "weekday": F.weekday,
        "hour": F.hour, "minute": F.minute,
    }
    return prepared.select(
        *[col(c) for c in df.columns],
        *[part[f](ts).cast("long").alias(f"{column}_{f}") for f in features],
    )


def _require_encodable(df: DataFrame, names) -> list[str]:
    require_columns(df, names)
    wrong = [n for n in names if is_numeric(df.schema[n])]
    if wrong:
        raise ValueError(f"numeric columns need no encoding: {wrong}")
    return names


def label_mapping(df: DataFrame, column: str, order_by) -> DataFrame:
    """Rows ``(value, code)``: codes count up by first appearance in key order."""
    keys = as_list(order_by)
    # Written once: numbering reads its input three times.
    first = checkpoint(
        df.filter(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.min(key_struct(keys)).alias("first"))
    )
    return with_row_number(first, ["first"], "code").select("value", "code")


def encode_label(df: DataFrame, columns, order_by) -> tuple[DataFrame, DataFrame]:
    """Integer codes by first appearance, null is -1; returns the table and the mapping."""
    names = _require_encodable(df, as_list(columns))
    keys = require_columns(df, as_list(order_by))
    if not keys:
        raise ValueError("label codes follow row order: pass order_by")
    encoded, mappings = df, None
    for i, n in enumerate(names):
        codes = sized(label_mapping(df, n, keys))
        named = codes.select(F.lit(n).alias("column"), F.col("value").cast("string"), "code")
        mappings = named if mappings is None else mappings.unionByName(named)
        right = codes.select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__c{i}"))
        encoded = encoded.join(right, col(n) == F.col(f"__v{i}"), "left")
    codes = {n: F.coalesce(F.col(f"__c{i}"), F.lit(-1).cast("long")) for i, n in enumerate(names)}
    return (
        encoded.select(*[codes[c].alias(c) if c in codes else col(c) for c in df.columns]),
        mappings,
    )


def encode_onehot(df: DataFrame, columns, limit: int = ONEHOT_LIMIT) -> DataFrame:
    """0/1 columns per value, sorted; a column with more than ``limit`` values is an error."""
    names = _require_encodable(df, as_list(columns))
    added = []
    for n in names:
        text = to_text(df.schema[n])
        found = (
            df.filter(col(n).isNotNull()).select(text.alias("v")).distinct().limit(limit + 1).collect()
        )
        if len(found) > limit:
            raise ValueError(f"column '{n}' has more than {limit} distinct values")
        for v in sorted(r["v"] for r in found):
            added.append(F.when(text == F.lit(v), 1).otherwise(0).alias(f"{n}_{v}"))
    kept = [col(c) for c in df.columns if c not in names]
    return df.select(*kept, *added)
