"""Table and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gristmill.functions.moments import share
from gristmill.functions.text import to_text
from gristmill.functions.types import (
    as_list,
    col,
    is_datetime,
    is_nested,
    is_numeric,
    numeric_columns,
    require_columns,
    require_order,
    require_range,
)
from gristmill.plans.stats import attach, literal, quantiles, tidy, with_distinct_counts

PREVIEW_ROWS = 100
PREVIEW_CAP = 10_000


def _profiled(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if not is_nested(f)]


def _counts(df: DataFrame, fields, approx: bool) -> DataFrame:
    stats = [F.count(F.lit(1)).alias("total"), *[F.count(col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)]]
    if approx:
        return df.agg(*stats, *[F.approx_count_distinct(col(f.name)).alias(f"u{i}") for i, f in enumerate(fields)])
    return with_distinct_counts(df.agg(*stats), df, [f.name for f in fields])


def inspect(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, null and distinct counts of every column."""
    fields = _profiled(df)
    rows = []
    for i, f in enumerate(fields):
        filled, unique = F.col(f"c{i}"), F.col(f"u{i}")
        nulls = F.col("total") - filled
        rows.append(
            {
                "column": F.lit(f.name),
                "dtype": F.lit(f.dataType.simpleString()),
                "non_null": filled,
                "nulls": nulls,
                "null_pct": share(nulls, F.col("total"), 1),
                "unique_count": unique,
                "is_unique": unique == filled,
            }
        )
    return tidy(_counts(df, fields, approx), rows)


def cleaning_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """The part of the column profile that cleaning decisions need."""
    return inspect(df, approx).select("column", "dtype", "null_pct", "unique_count")


def _moments(fields) -> list[Column]:
    out = []
    for i, f in enumerate(fields):
        c = col(f.name).cast("double")
        out += [
            F.count(c).alias(f"n{i}"),
            F.avg(c).alias(f"mean{i}"),
            F.stddev_samp(c).alias(f"std{i}"),
            F.min(c).alias(f"min{i}"),
            F.max(c).alias(f"max{i}"),
        ]
    return out


def describe_numeric(df: DataFrame, approx: bool = False) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of the numeric columns."""
    fields = [f for f in df.schema if is_numeric(f)]
    names = [f.name for f in fields]
    if not names:
        raise ValueError("the table has no numeric column")
    q = quantiles(df, names, [0.25, 0.5, 0.75], approx)
    return tidy(
        df.agg(*_moments(fields)),
        [
            {
                "column": F.lit(n),
                "count": F.col(f"n{i}"),
                "mean": F.col(f"mean{i}"),
                "std": F.col(f"std{i}"),
                "min": F.col(f"min{i}"),
                "p25": literal(q[i, 0]),
                "p50": literal(q[i, 1]),
                "p75": literal(q[i, 2]),
                "max": F.col(f"max{i}"),
            }
            for i, n in enumerate(names)
        ],
    )


def _long_counts(df: DataFrame, fields, keep_null: bool) -> DataFrame:
    """``(column, value, count)`` of several columns from one scan."""
    entries = F.array(
        *[F.struct(F.lit(f.name).alias("column"), to_text(f).alias("value")) for f in fields]
    )
    cells = df.select(F.inline(entries))
    if not keep_null:
        cells = cells.filter(F.col("value").isNotNull())
    return cells.groupBy("column", "value").count()


def describe_text(df: DataFrame) -> DataFrame:
    """Count, distinct values, most frequent value (smallest on a tie) of the text columns."""
    fields = [f for f in _profiled(df) if not is_numeric(f) and not is_datetime(f)]
    if not fields:
        raise ValueError("the table has no text column")
    counts = _long_counts(df, fields, keep_null=False)
    order = F.struct(-F.col("count"), F.col("value"))
    found = counts.groupBy("column").agg(
        F.sum("count").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", order).alias("top"),
        F.max("count").alias("freq"),
    )
    return found


def describe_datetime(df: DataFrame, approx: bool = False) -> DataFrame:
    """Count, mean, extremes and quartiles of the time columns (micro-second precision)."""
    fields = [f for f in df.schema if is_datetime(f)]
    if not fields:
        raise ValueError("the table has no date or time column")
    names = [f.name for f in fields]
    micros = df.select(*[F.unix_micros(col(n).cast("timestamp")).alias(n) for n in names])
    q = quantiles(micros, names, [0.25, 0.5, 0.75], approx)
    aggregates = []
    for i, n in enumerate(names):
        exact = F.sum(col(n).cast("decimal(38,0)")) / F.count(col(n)).cast("decimal(20,0)")
        aggregates += [
            F.count(col(n)).alias(f"n{i}"),
            F.floor(F.when(F.count(col(n)) > 0, exact)).cast("long").alias(f"mean{i}"),
            F.min(col(n)).alias(f"min{i}"),
            F.max(col(n)).alias(f"max{i}"),
        ]

    def moment(value):
        return F.timestamp_micros(F.floor(value).cast("long"))

    return tidy(
        micros.agg(*aggregates),
        [
            {
                "column": F.lit(n),
                "count": F.col(f"n{i}"),
                "mean": moment(F.col(f"mean{i}")),
                "min": moment(F.col(f"min{i}")),
                "p25": moment(literal(q[i, 0])),
                "p50": moment(literal(q[i, 1])),
                "p75": moment(literal(q[i, 2])),
                "max": moment(F.col(f"max{i}")),
            }
            for i, n in enumerate(names)
        ],
    )


def summary_stats(df: DataFrame, top_n: int = 5, approx: bool = False) -> DataFrame:
    """Rows ``(column, total_rows, missing, statistic, value, count)``.

    Numeric columns report min, max, mean, median and std; the others their most
    frequent values as ``top1``, ``top2`` and so on.
    """
    fields = _profiled(df)
    numbers = [f for f in fields if is_numeric(f)]
    others = [f for f in fields if not is_numeric(f)]
    totals = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(col(f.name)).alias(f"c_{f.name}") for f in fields],
        *_moments(numbers),
    )
    parts = []
    if numbers:
        names = [f.name for f in numbers]
        medians = quantiles(df, names, [0.5], approx)
        rows = []
        for i, n in enumerate(names):
            for label, value in (
                ("min", F.col(f"min{i}")),
                ("max", F.col(f"max{i}")),
                ("mean", F.col(f"mean{i}")),
                ("median", literal(medians[i, 0])),
                ("std", F.col(f"std{i}")),
            ):
                rows.append(
                    {
                        "column": F.lit(n),
                        "total_rows": F.col("total"),
                        "missing": F.col("total") - col(f"c_{n}"),
                        "statistic": F.lit(label),
                        "number": value,
                        "value": F.lit(None).cast("string"),
                        "count": F.lit(None).cast("long"),
                    }
                )
        parts.append(tidy(totals, rows))
    if others:
        counts = top_values(_long_counts(df, others, keep_null=False), top_n)
        missing = F.create_map(
            *[x for f in others for x in (F.lit(f.name), F.col("total") - col(f"c_{f.name}"))]
        )
        labelled = attach(counts, totals.select("total", missing.alias("missing")), "t")
        parts.append(
            labelled.select(
                "column",
                F.col("t.total").alias("total_rows"),
                F.col("t.missing")[F.col("column")].alias("missing"),
                F.concat(F.lit("top"), F.col("rank").cast("string")).alias("statistic"),
                F.lit(None).cast("double").alias("number"),
                "value",
                "count",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_values(counts: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` most frequent values per column; the rank limit prunes before the shuffle."""
    order = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def profile_context(df: DataFrame) -> DataFrame:
    """Shape, null share and location statistics per column in one aggregate."""
    fields = _profiled(df)
    stats = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)],
        *_moments([f for f in fields if is_numeric(f)]),
    )
    rows, k = [], 0
    none = F.lit(None).cast("double")
    for i, f in enumerate(fields):
        row = {
            "column": F.lit(f.name),
            "dtype": F.lit(f.dataType.simpleString()),
            "total_rows": F.col("total"),
            "total_columns": F.lit(len(df.columns)).cast("long"),
            "null_pct": share(F.col("total") - F.col(f"c{i}"), F.col("total"), 1),
        }
        for label in ("mean", "std", "min", "max"):
            row[label] = F.col(f"{label}{k}") if is_numeric(f) else none
        k += is_numeric(f)
        rows.append(row)
    return tidy(stats, rows)


def first_rows(df: DataFrame, order_by, rows: int = 5) -> DataFrame:
    keys = require_order(df, order_by)
    return df.orderBy(*[col(k) for k in keys]).limit(rows)


def sample_stats(df: DataFrame, max_columns: int = 8) -> DataFrame:
    """Mean and deviation of the first numeric columns, 3 digits."""
    names = numeric_columns(df)[:max_columns]
    if not names:
        raise ValueError("the table has no numeric column")
    stats = df.agg(
        *[F.avg(col(n)).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.stddev_samp(col(n)).alias(f"s{i}") for i, n in enumerate(names)],
    )
    return tidy(
        stats,
        [
            {"column": F.lit(n), "mean": F.round(f"m{i}", 3), "std": F.round(f"s{i}", 3)}
            for i, n in enumerate(names)
        ],
    )


def preview(df: DataFrame, order_by, limit: int = PREVIEW_ROWS, columns=None) -> DataFrame:
    """The first rows in key order; 0 asks for all of them."""
    keys = require_order(df, order_by)
    require_range(limit, 0, PREVIEW_CAP, "limit")
    names = require_columns(df, as_list(columns)) or df.columns
    shown = df.orderBy(*[col(k) for k in keys])
    shown = shown.limit(limit) if limit else shown
    return shown.select(*[col(c) for c in names])


def preview_info(df: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """One row: how many rows the table has, how many a preview shows."""
    total = F.col("total_rows")
    shown = F.least(total, F.lit(limit).cast("long")) if limit else total
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        total, shown.alias("returned_rows"), (total > shown).alias("truncated")
    )
