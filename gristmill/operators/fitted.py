"""Statistics that are computed once, kept, and applied to other tables or to streams.

``fit_*`` reads a table and returns a ``Fitted``: a few numbers or values per column. Applying it
plans projections and filters with these numbers as literals, so it runs on a streaming DataFrame,
reaches the scan, and treats new rows as the first table's rows were treated. On the table it was
fitted on, the result equals that of the operator of the same name.

``LabelCodes`` is the exception: a column may have very many labels, so they stay a table, which is
written and joined.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gristmill.functions.text import to_text
from gristmill.functions.types import as_list, col, is_integer, is_numeric, replace_columns, require_choice, require_columns, require_numeric, require_range
from gristmill.operators.columns import _typed_value
from gristmill.operators.outliers import IMPUTE, Spread, _outlying, _spreads
from gristmill.operators.transforms import ONEHOT_LIMIT, SCALERS, TRANSFORMS, _require_encodable, label_mapping
from gristmill.plans.session import checkpoint, is_small
from gristmill.plans.stats import literal, most_frequent, quantiles

FILLS = ("constant", "mean", "median", "mode")


@dataclass(frozen=True)
class Fitted:
    """One operator with its options and what it learned of each column; plain JSON values only."""

    operator: str
    options: Mapping[str, object] = field(default_factory=dict)
    columns: Mapping[str, Mapping[str, object]] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        require_columns(df, list(self.columns))
        return APPLY[self.operator](self, df)

    def to_json(self) -> str:
        return json.dumps({"operator": self.operator, "options": dict(self.options), "columns": {k: dict(v) for k, v in self.columns.items()}})

    @classmethod
    def from_json(cls, text: str) -> Fitted:
        read = json.loads(text)
        require_choice(read["operator"], tuple(APPLY), "operator")
        return cls(read["operator"], read["options"], read["columns"])


def save(spark: SparkSession, steps: list[Fitted], path: str) -> None:
    """Write steps in their order, as one JSON text each, to any folder Spark can write."""
    rows = [(i, s.to_json()) for i, s in enumerate(steps)]
    spark.createDataFrame(rows, "step int, fitted string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> list[Fitted]:
    return [Fitted.from_json(r["fitted"]) for r in spark.read.parquet(path).orderBy("step").collect()]  # one row a step


def apply_all(df: DataFrame, steps: list[Fitted]) -> DataFrame:
    for step in steps:
        df = step.apply(df)
    return df


def _kept_value(value, kind: T.DataType) -> dict:
    """A value as JSON: its text form and the type to cast it back to."""
    text = value if value is None or isinstance(value, str) else repr(value) if isinstance(value, float) else str(value)
    return {"value": text, "type": kind.simpleString()}


def _value(kept: Mapping) -> Column:
    return F.lit(kept["value"]).cast(kept["type"])


def _modes(df: DataFrame, names) -> dict[str, object]:
    """Most frequent value of each column, by the grouped count of the batch operators."""
    return {n: most_frequent(df, n).first()["mode"] for n in names}


# Missing values.


def fit_fill(df: DataFrame, strategy: str, columns=None, value=None, approx: bool = False) -> Fitted:
    """What ``fill_nulls`` would put in; columns it would skip are left out."""
    require_choice(strategy, FILLS, "strategy")
    names = require_columns(df, as_list(columns)) or df.columns
    if strategy == "constant":
        if value is None:
            raise ValueError("strategy 'constant' needs a value")
        for n in names:  # refuse a value that does not fit
            _typed_value(df.schema[n], value)
        return Fitted("fill", {"strategy": strategy, "value": value}, {n: {} for n in names})
    if strategy == "mode":
        found = _modes(df, names)
        return Fitted("fill", {"strategy": strategy}, {n: _kept_value(found[n], df.schema[n].dataType) for n in names if found[n] is not None})
    names = [n for n in names if is_numeric(df.schema[n])]
    if strategy == "mean":
        row = df.agg(F.lit(0), *[F.avg(col(n)).cast("double").alias(f"s{i}") for i, n in enumerate(names)]).first()
        found = {n: row[f"s{i}"] for i, n in enumerate(names)}
    else:
        medians = quantiles(df, names, [0.5], approx) if names else {}
        found = {n: medians[i, 0] for i, n in enumerate(names)}
    return Fitted("fill", {"strategy": strategy}, {n: {"number": v} for n, v in found.items() if v is not None})


def _apply_fill(fitted: Fitted, df: DataFrame) -> DataFrame:
    exprs = {}
    for n, kept in fitted.columns.items():
        kind = df.schema[n]
        if fitted.options["strategy"] == "constant":
            new = _typed_value(kind, fitted.options["value"])
        elif "number" in kept:
            new = F.rint(literal(kept["number"])) if is_integer(kind) else literal(kept["number"])
        else:
            new = _value(kept)
        exprs[n] = F.coalesce(col(n), new.cast(kind.dataType))
    return replace_columns(df, exprs)


# Scaling and transforms.


def fit_scale(df: DataFrame, columns, method: str) -> Fitted:
    """Base and width of each column; columns without spread are left as they are."""
    require_choice(method, SCALERS, "method")
    names = require_numeric(df, as_list(columns))
    aggregates = []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        pair = (F.min(c), F.max(c) - F.min(c)) if method == "minmax" else (F.avg(c), F.stddev_samp(c))
        aggregates += [pair[0].alias(f"base{i}"), pair[1].alias(f"width{i}")]
    row = df.agg(*aggregates).first()
    return Fitted("scale", {"method": method}, {n: {"base": row[f"base{i}"], "width": row[f"width{i}"]} for i, n in enumerate(names)})


def _apply_scale(fitted: Fitted, df: DataFrame) -> DataFrame:
    exprs = {}
    for n, kept in fitted.columns.items():
        c = col(n).cast("double")
        usable = kept["width"] is not None and kept["width"] > 0
        exprs[n] = (c - literal(kept["base"])) / literal(kept["width"]) if usable else c
    return replace_columns(df, exprs)


def fit_transform(df: DataFrame, columns, function: str) -> Fitted:
    """Whether each column lies in the function's domain; a new value outside it becomes null."""
    require_choice(function, TRANSFORMS, "function")
    names = require_numeric(df, as_list(columns))
    row = df.agg(*[F.min(col(n)).cast("double").alias(f"low{i}") for i, n in enumerate(names)]).first()
    inside = {"log": lambda low: low > 0, "sqrt": lambda low: low >= 0, "cbrt": lambda low: True}[function]
    return Fitted("transform", {"function": function}, {n: {"usable": row[f"low{i}"] is not None and inside(row[f"low{i}"])} for i, n in enumerate(names)})


def _apply_transform(fitted: Fitted, df: DataFrame) -> DataFrame:
    name = fitted.options["function"]
    function = {"log": lambda c: F.when(c > 0, F.ln(c)), "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)), "cbrt": F.cbrt}[name]
    exprs = {}
    for n, kept in fitted.columns.items():
        c = col(n).cast("double")
        exprs[n] = function(c) if kept["usable"] else c
    return replace_columns(df, exprs)


# Outliers.


def fit_bounds(df: DataFrame, columns, method: str = "iqr", threshold: float = 1.5, impute: str | None = None, approx: bool = False) -> Fitted:
    """Outlier bounds, to trim rows by, or with ``impute`` the value that takes an outlier's place."""
    names = require_numeric(df, as_list(columns))
    if impute is not None:
        require_choice(impute, IMPUTE, "strategy")
    spreads = _spreads(df, names, method, threshold, impute == "median", approx)
    modes = _modes(df, names) if impute == "mode" else {}
    kept = {}
    for n, s in zip(names, spreads):
        kept[n] = {"lower": s.lower, "upper": s.upper, "std": s.std}
        if impute == "mode":
            kept[n] |= _kept_value(modes[n], df.schema[n].dataType)
        elif impute:
            kept[n]["number"] = s.mean if impute == "mean" else s.median
    return Fitted("impute" if impute else "trim", {"method": method}, kept)


def _outside(fitted: Fitted, n: str) -> Column:
    kept = fitted.columns[n]
    return _outlying(n, Spread(kept["lower"], kept["upper"], None, kept["std"], None, None), fitted.options["method"])


def _apply_trim(fitted: Fitted, df: DataFrame) -> DataFrame:
    for n in fitted.columns:
        df = df.filter(~_outside(fitted, n))
    return df


def _apply_impute(fitted: Fitted, df: DataFrame) -> DataFrame:
    exprs = {}
    for n, kept in fitted.columns.items():
        kind = df.schema[n]
        if "number" in kept:
            new = F.rint(literal(kept["number"])) if is_integer(kind) else literal(kept["number"])
        else:
            new = _value(kept)
        exprs[n] = F.when(_outside(fitted, n), new.cast(kind.dataType)).otherwise(col(n))
    return replace_columns(df, exprs)


def fit_cap(df: DataFrame, columns, lower_pct: float = 5, upper_pct: float = 95, approx: bool = False) -> Fitted:
    """Percentiles that ``cap_outliers`` clamps to."""
    require_range(lower_pct, 0, 100, "lower_pct")
    require_range(upper_pct, 0, 100, "upper_pct")
    if lower_pct >= upper_pct:
        raise ValueError("lower_pct must be below upper_pct")
    names = require_numeric(df, as_list(columns))
    q = quantiles(df, names, [lower_pct / 100, upper_pct / 100], approx)
    return Fitted("cap", {}, {n: {"low": q[i, 0], "high": q[i, 1]} for i, n in enumerate(names)})


def _apply_cap(fitted: Fitted, df: DataFrame) -> DataFrame:
    exprs = {}
    for n, kept in fitted.columns.items():
        c, low, high = col(n).cast("double"), literal(kept["low"]), literal(kept["high"])
        exprs[n] = F.when(c < low, low).when(c > high, high).otherwise(c)
    return replace_columns(df, exprs)


# Encodings.


def fit_onehot(df: DataFrame, columns, limit: int = ONEHOT_LIMIT) -> Fitted:
    """The sorted values of each column; a value met later is 0 in all columns."""
    names = _require_encodable(df, as_list(columns))
    kept = {}
    for n in names:
        found = df.filter(col(n).isNotNull()).select(to_text(df.schema[n]).alias("v")).distinct().limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"column '{n}' has more than {limit} distinct values")
        kept[n] = {"values": sorted(r["v"] for r in found)}
    return Fitted("onehot", {}, kept)


def _apply_onehot(fitted: Fitted, df: DataFrame) -> DataFrame:
    added = [
        F.when(to_text(df.schema[n]) == F.lit(v), 1).otherwise(0).alias(f"{n}_{v}") for n, kept in fitted.columns.items() for v in kept["values"]
    ]
    return df.select(*[col(c) for c in df.columns if c not in fitted.columns], *added)


APPLY: dict[str, Callable[[Fitted, DataFrame], DataFrame]] = {
    "fill": _apply_fill,
    "scale": _apply_scale,
    "transform": _apply_transform,
    "trim": _apply_trim,
    "impute": _apply_impute,
    "cap": _apply_cap,
    "onehot": _apply_onehot,
}


class LabelCodes:
    """Label codes of some columns as a written table ``(column, value, code)``.

    Null and labels that were not met when fitting get -1. The table is broadcast only if its
    rows and bytes were counted small.
    """

    def __init__(self, table: DataFrame, names: list[str]):
        self.table, self.names = table, names

    @classmethod
    def fit(cls, df: DataFrame, columns, order_by) -> LabelCodes:
        names = _require_encodable(df, as_list(columns))
        if not as_list(order_by):
            raise ValueError("label codes follow row order: pass order_by")
        keyed = [label_mapping(df, n, order_by).select(F.lit(n).alias("column"), F.col("value").cast("string").alias("value"), "code") for n in names]
        table = keyed[0]
        for more in keyed[1:]:
            table = table.unionByName(more)
        return cls(checkpoint(table), names)

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").partitionBy("column").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LabelCodes:
        table = spark.read.schema("value string, code long, column string").parquet(path)
        return cls(table, sorted(r["column"] for r in table.select("column").distinct().collect()))  # one row a column

    def apply(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.names)
        coded = df
        for i, n in enumerate(self.names):
            one = self.table.filter(F.col("column") == n).select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__c{i}"))
            one = F.broadcast(one) if is_small(self.table.filter(F.col("column") == n).select("value")) else one
            coded = coded.join(one, col(n).cast("string") == F.col(f"__v{i}"), "left")
        codes = {n: F.coalesce(F.col(f"__c{i}"), F.lit(-1).cast("long")) for i, n in enumerate(self.names)}
        return coded.select(*[codes[c].alias(c) if c in codes else col(c) for c in df.columns])
