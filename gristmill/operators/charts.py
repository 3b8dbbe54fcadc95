"""Chart aggregations as tidy rows ``(series, x, y, rank)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gristmill.functions.moments import pearson
from gristmill.functions.text import float_to_string, to_text
from gristmill.functions.types import (
    as_list,
    col,
    is_integer,
    require_choice,
    require_columns,
    require_numeric,
    require_order,
    require_range,
)
from gristmill.operators.eda import (
    BINS,
    MAX_SAMPLE,
    SAMPLE,
    distribution_bins,
    pairwise_points,
    pairwise_r,
    sample_order,
)
from gristmill.plans.ordering import top_per_group, with_row_number
from gristmill.plans.session import checkpoint
from gristmill.plans.stats import attach, stat

AGGREGATIONS = ("sum", "mean", "count", "min", "max")
LIMIT, MAX_LIMIT = 20, 100
PIE_LIMIT = 10
TREEMAP_LIMIT = 20


def aggregate(name: str, c: Column) -> Column:
    """The value as double; the sum of nothing is 0."""
    require_choice(name, AGGREGATIONS, "aggregation")
    if name == "sum":
        return F.coalesce(F.sum(c), F.lit(0)).cast("double")
    if name == "mean":
        return F.avg(c).cast("double")
    return {"count": F.count, "min": F.min, "max": F.max}[name](c).cast("double")


def _check(df: DataFrame, keys: Sequence[str], value: str, agg: str, limit: int):
    require_columns(df, [*keys, value])
    if agg != "count":
        require_numeric(df, [value])
    require_range(limit, 1, MAX_LIMIT, "limit")


def _grouped(df: DataFrame, name: str, value: str, agg: str) -> DataFrame:
    return (
        df.filter(col(name).isNotNull())
        .groupBy(to_text(df.schema[name]).alias("x"))
        .agg(aggregate(agg, col(value)).alias("y"))
    )


def _ranked(rows: DataFrame, order: Sequence[Column], limit: int, name: str = "rank") -> DataFrame:
    """Top rows with their 1-based rank; the rank is taken over at most ``limit`` rows."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def bar(
    df: DataFrame, x: str, y: str, agg: str = "sum", limit: int = LIMIT, group_by: str | None = None,
    max_groups: int | None = None,
) -> DataFrame:
    """Top categories by the size of their aggregate; one series, or one per group.

    ``max_groups`` keeps the largest groups only; without it every group is a series.
    """
    if group_by:
        return _bar_grouped(df, x, y, group_by, agg, limit, max_groups)
    _check(df, [x], y, agg, limit)
    order = [F.abs("y").desc_nulls_last(), F.col("x")]
    top = _ranked(_grouped(df, x, y, agg), order, limit)
    return top.select(F.lit(y).alias("series"), "x", "y", "rank")


def _bar_grouped(
    df: DataFrame, x: str, y: str, g: str, agg: str, limit: int, max_groups: int | None
) -> DataFrame:
    _check(df, [x, g], y, agg, limit)
    if x == g:
        raise ValueError("choose two different columns")
    cells = (
        df.filter(col(x).isNotNull() & col(g).isNotNull())
        .groupBy(to_text(df.schema[x]).alias("x"), to_text(df.schema[g]).alias("g"))
        .agg(aggregate(agg, col(y)).alias("y"))
    )
    totals = cells.groupBy("x").agg(F.sum("y").alias("total"))
    kept = _ranked(totals, [F.abs("total").desc_nulls_last(), F.col("x")], limit).select("x", "rank")
    # ``kept`` holds at most ``limit`` (100) rows.
    inside = cells.join(F.broadcast(kept), "x")
    groups = inside.groupBy("g").agg(F.sum(F.abs(F.coalesce("y", F.lit(0.0)))).alias("size"))
    if max_groups is not None:
        require_range(max_groups, 1, 1_000_000, "max_groups")
        groups = groups.orderBy(F.col("size").desc(), F.col("g")).limit(max_groups)
    # Every group meets the at most ``limit`` (100) categories.
    shown = kept.agg(F.collect_list(F.struct("x", "rank")).alias("xs"))
    grid = attach(groups.select("g"), shown).select("g", F.inline(stat("xs")))
    cell = inside.select("x", "g", F.struct("y").alias("cell"))
    filled = grid.join(cell, ["x", "g"], "left")
    value = F.when(F.col("cell").isNull(), F.lit(0.0)).otherwise(F.col("cell.y"))
    return filled.select(F.col("g").alias("series"), "x", value.alias("y"), "rank")


def line(df: DataFrame, x: str, ys, order_by, sort: bool = True, points: int | None = None) -> DataFrame:
    """Points ordered by x (then key), one series per y column.

    ``points`` keeps the first ones only, as a browser needs; without it all are kept, and
    their ranks come from distributed row numbers.
    """
    names = require_numeric(df, as_list(ys))
    if not names:
        raise ValueError("a line chart needs at least one y column")
    require_columns(df, [x])
    keys = require_order(df, order_by)
    sorting = list(dict.fromkeys([x, *keys] if sort else keys))
    present = df.filter(col(x).isNotNull())
    if points is None:
        used = list(dict.fromkeys([x, *keys, *names]))
        numbered = with_row_number(present.select(*[col(c) for c in used]), sorting, "rank")
        numbered = numbered.withColumn("rank", (F.col("rank") + 1).cast("long"))
    else:
        require_range(points, 1, 1_000_000, "points")
        order = [col(c) for c in sorting]
        numbered = present.orderBy(*order).limit(points)
        numbered = numbered.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    series = F.array(
        *[F.struct(F.lit(n).alias("series"), col(n).cast("double").alias("y")) for n in names]
    )
    return numbered.select(
        to_text(df.schema[x]).alias("x"), "rank", F.inline(series)
    ).select("series", "x", "y", "rank")


def scatter(
    df: DataFrame, x: str, y: str, order_by, color_by: str | None = None, sample: int = SAMPLE
) -> DataFrame:
    """Sampled points with the correlation of the full set on every row."""
    keys = require_order(df, order_by)
    if color_by is None:
        points = pairwise_points(df, x, y, keys, sample).withColumn("series", F.lit(f"{x} vs {y}"))
        return attach(points, pairwise_r(df, x, y)).select(
            "series", "x", "y", stat("r").alias("pearson_r")
        )
    require_numeric(df, [x, y])
    require_columns(df, [color_by])
    require_range(sample, 1, MAX_SAMPLE, "sample")
    complete = df.filter(col(x).isNotNull() & col(y).isNotNull() & col(color_by).isNotNull())
    series = to_text(df.schema[color_by])
    points = complete.select(
        series.alias("series"),
        col(x).alias("x"),
        col(y).alias("y"),
        sample_order(keys).alias("__order"),
        *[col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
    )
    order = [F.col("__order"), *[F.col(f"__k{i}") for i in range(len(keys))]]
    points = top_per_group(points, ["series"], order, sample, "n")
    full = complete.agg(F.count(F.lit(1)).alias("n"), pearson(col(x), col(y)).alias("r"))
    full = full.select(F.when(F.col("n") >= 3, F.round("r", 4)).alias("r"))
    return attach(points, full).select("series", "x", "y", stat("r").alias("pearson_r"))


def histogram(df: DataFrame, columns, bins: int = BINS) -> DataFrame:
    """Distribution bins in chart form: the label is the range of the bin."""
    rows = distribution_bins(df, columns, bins)
    label = F.concat(float_to_string(F.col("range_start")), F.lit("–"), float_to_string(F.col("range_end")))
    return rows.select(
        F.col("column").alias("series"), label.alias("x"), F.col("count").alias("y"), (F.col("bin") + 1).alias("rank")
    )


def kpi(df: DataFrame, value: str, agg: str = "sum", label: str | None = None) -> DataFrame:
    """One number and its display text (``1.2M``, ``3.4K``, two digits, or an integer)."""
    require_columns(df, [value])
    if agg != "count":
        require_numeric(df, [value])
    whole = agg == "count" or (agg != "mean" and is_integer(df.schema[value]))
    number = df.agg(aggregate(agg, col(value)).alias("value"))
    v = F.col("value")
    if whole:
        text = v.cast("long").cast("string")
    else:
        text = (
            F.when(F.abs(v) >= 1_000_000, F.concat(F.format_string("%.1f", v / 1_000_000), F.lit("M")))
            .when(F.abs(v) >= 1_000, F.concat(F.format_string("%.1f", v / 1_000), F.lit("K")))
            .otherwise(F.format_string("%.2f", v))
        )
    return number.select(
        F.lit(label or f"{agg}({value})").alias("label"),
        "value",
        F.when(v.isNotNull(), text).alias("formatted_value"),
    )


def pie(df: DataFrame, name: str, value: str, agg: str = "sum", limit: int = PIE_LIMIT) -> DataFrame:
    """Largest groups by signed value, plus ``Others`` when groups are left out."""
    _check(df, [name], value, agg, limit)
    grouped = _grouped(df, name, value, agg)
    top = _ranked(grouped, [F.col("y").desc_nulls_last(), F.col("x")], limit)
    # At most ``limit`` values.
    shown = top.agg(F.sum("y").alias("top"))
    whole = grouped.agg(F.count(F.lit(1)).alias("groups"), F.sum("y").alias("all"))
    rest = (
        attach(whole, shown)
        .filter(F.col("groups") > limit)
        .select(
            F.lit("Others").alias("x"),
            (F.col("all") - stat("top")).alias("y"),
            F.lit(limit + 1).cast("long").alias("rank"),
        )
    )
    return top.unionByName(rest).select(F.lit(value).alias("series"), "x", "y", "rank")


def treemap(df: DataFrame, name: str, value: str, agg: str = "sum", limit: int = TREEMAP_LIMIT) -> DataFrame:
    """Largest groups by signed value."""
    _check(df, [name], value, agg, limit)
    order = [F.col("y").desc_nulls_last(), F.col("x")]
    top = _ranked(_grouped(df, name, value, agg), order, limit)
    return top.select(F.lit(value).alias("series"), "x", "y", "rank")


def _tidy_kpi(df: DataFrame, **params) -> DataFrame:
    out = kpi(df, **params)
    return out.select(
        F.col("label").alias("series"),
        F.col("formatted_value").alias("x"),
        F.col("value").alias("y"),
        F.lit(1).cast("long").alias("rank"),
    )


def _tidy_scatter(df: DataFrame, **params) -> DataFrame:
    out = scatter(df, **params)
    return out.select(
        "series", F.col("x").cast("double").cast("string").alias("x"), F.col("y").cast("double").alias("y"),
        F.lit(None).cast("long").alias("rank"),
    )


def _tidy_histogram(df: DataFrame, **params) -> DataFrame:
    return histogram(df, **params).withColumn("y", F.col("y").cast("double"))


RENDERERS = {
    "bar": bar,
    "line": line,
    "scatter": _tidy_scatter,
    "histogram": _tidy_histogram,
    "kpi": _tidy_kpi,
    "pie": pie,
    "treemap": treemap,
}
IGNORED_WIDGETS = ("text", "report")


def render_widgets(df: DataFrame, specs: Sequence[dict]) -> tuple[DataFrame | None, dict[str, str]]:
    """Evaluate many chart specs ``{"id", "chart_type", "chart_params"}`` over one table.

    Returns the union of the tidy outputs and the errors of the specs that failed. Each chart
    is evaluated and written by a job of its own, so that data on which one fails (an infinite
    value in a histogram, say) leaves the others whole; scans are pruned to a chart's columns.
    """
    out, errors = None, {}
    for spec in specs:
        kind = spec.get("chart_type")
        if kind in IGNORED_WIDGETS:
            continue
        widget = str(spec.get("id"))
        try:
            if kind not in RENDERERS:
                raise ValueError(f"unknown chart type '{kind}'")
            rows = RENDERERS[kind](df, **spec.get("chart_params", {}))
            rows = checkpoint(rows.select(F.lit(widget).alias("widget_id"), "series", "x", "y", "rank"))
        except Exception as problem:
            errors[widget] = str(problem).split("\n\nJVM stacktrace")[0]
            continue
        out = rows if out is None else out.unionByName(rows)
    return out, errors
