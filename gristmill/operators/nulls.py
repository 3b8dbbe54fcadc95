"""Dropping and filling missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gristmill.functions.types import (
    MutationResult,
    as_list,
    col,
    is_integer,
    is_numeric,
    replace_columns,
    require_choice,
    require_columns,
    require_order,
    require_range,
)
from gristmill.operators.columns import _typed_value
from gristmill.plans.ordering import fill_along
from gristmill.plans.stats import attach, literal, most_frequent, quantiles, stat, tidy

STRATEGIES = ("constant", "mean", "median", "mode", "ffill", "bfill")


def drop_nulls(df: DataFrame, how: str = "any", subset=None) -> DataFrame:
    """Drop rows with any (or only) nulls among ``subset``."""
    require_choice(how, ("any", "all"), "how")
    names = require_columns(df, as_list(subset)) or df.columns
    return df.na.drop(how, subset=names)


def drop_null_columns(df: DataFrame, threshold: float) -> DataFrame:
    """Drop the columns whose null percentage exceeds ``threshold``.

    The schema of the result depends on the data, so this runs one aggregate job.
    """
    require_range(threshold, 0, 100, "threshold")
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
    ).first()
    total = row["n"]
    if not total:
        return df
    gone = [
        c
        for i, c in enumerate(df.columns)
        if (total - row[f"c{i}"]) * 100.0 / total > threshold
    ]
    return df.drop(*gone)


def fill_nulls(
    df: DataFrame, strategy: str, columns=None, value=None, order_by=None, approx: bool = False
) -> MutationResult:
    """Fill nulls; ``metrics`` reports cells filled and whether a column was skipped."""
    require_choice(strategy, STRATEGIES, "strategy")
    names = require_columns(df, as_list(columns)) or df.columns
    if strategy == "constant" and value is None:
        raise ValueError("strategy 'constant' needs a value")
    usable = list(names)
    if strategy in ("mean", "median"):
        usable = [n for n in names if is_numeric(df.schema[n])]
    nulls = df.agg(
        *[F.count_if(col(n).isNull()).alias(f"n{i}") for i, n in enumerate(names)],
        *[F.count(col(n)).alias(f"c{i}") for i, n in enumerate(names)],
    )
    rows = []
    for i, n in enumerate(names):
        blocked = F.lit(n not in usable)
        if strategy not in ("constant", "ffill", "bfill"):
            blocked = blocked | (F.col(f"c{i}") == 0)
        rows.append(
            {
                "column": F.lit(n),
                "nulls": F.col(f"n{i}"),
                "skipped": blocked,
                "cells_filled": F.when(blocked, F.lit(0).cast("long")).otherwise(F.col(f"n{i}")),
            }
        )
    if strategy in ("ffill", "bfill"):
        keys = require_order(df, order_by)
        filled = fill_along(df, usable, keys, strategy == "bfill")
        left = filled.agg(*[F.count_if(col(n).isNull()).alias(f"l{i}") for i, n in enumerate(names)])
        nulls = attach(nulls, left, "left")
        for i, row in enumerate(rows):
            row["cells_filled"] = F.col(f"n{i}") - F.col("left").getField(f"l{i}")
        return MutationResult(filled, tidy(nulls, rows))
    metrics = tidy(nulls, rows)
    if strategy == "constant":
        exprs = {n: F.coalesce(col(n), _typed_value(df.schema[n], value)) for n in usable}
        return MutationResult(replace_columns(df, exprs), metrics)
    prepared = df
    if strategy == "mode":
        # One grouped count per column: a mode over many values must not sit in one buffer.
        replacements = {}
        for i, n in enumerate(usable):
            prepared = attach(prepared, most_frequent(df, n), f"__mode{i}")
            replacements[n] = F.col(f"__mode{i}").getField("mode")
    elif not usable:
        return MutationResult(df, metrics)
    else:
        if strategy == "mean":
            stats = df.agg(*[F.avg(col(n)).alias(f"s{i}") for i, n in enumerate(usable)])
            prepared = attach(df, stats)
            replacements = {n: stat(f"s{i}") for i, n in enumerate(usable)}
        else:
            medians = quantiles(df, usable, [0.5], approx)
            replacements = {n: literal(medians[i, 0]) for i, n in enumerate(usable)}
    exprs = {}
    for n in usable:
        new = replacements[n]
        if strategy != "mode" and is_integer(df.schema[n]):
            new = F.rint(new)
        exprs[n] = F.coalesce(col(n), new.cast(df.schema[n].dataType))
    return MutationResult(
        prepared.select(*[exprs[c].alias(c) if c in exprs else col(c) for c in df.columns]), metrics
    )
