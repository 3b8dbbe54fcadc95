"""Row filters and duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from gristmill.functions.text import to_text
from gristmill.functions.types import (
    as_list,
    col,
    is_numeric,
    is_text,
    require_choice,
    require_columns,
    require_order,
)

FILTERS = (
    "eq", "ne", "gt", "gte", "lt", "lte", "contains", "not_contains", "isnull", "notnull",
)
DEDUP_MODES = ("all_first", "all_last", "subset_keep", "drop_all")


def filter_rows(df: DataFrame, column: str, operator: str, value=None) -> DataFrame:
    """Keep the rows that satisfy one comparison; plain predicates, so they push down."""
    require_columns(df, [column])
    require_choice(operator, FILTERS, "operator")
    if operator not in ("isnull", "notnull") and value is None:
        raise ValueError(f"operator '{operator}' needs a value")
    field = df.schema[column]
    c = col(column)
    if operator in ("gt", "gte", "lt", "lte") and not is_numeric(field):
        raise ValueError(f"operator '{operator}' needs a numeric column")
    if operator == "isnull":
        return df.filter(c.isNull())
    if operator == "notnull":
        return df.filter(c.isNotNull())
    if operator in ("contains", "not_contains"):
        text = c if is_text(field) else to_text(field)
        found = text.contains(F.lit(str(value)))
        if operator == "contains":
            return df.filter(found)
        return df.filter(~F.coalesce(found, F.lit(False)))
    wanted = F.lit(value)
    if operator in ("eq", "ne"):
        # A value of another kind equals nothing: it becomes null instead of failing a cast. Only dates are
        # written as text: the text '1' is neither the number 1 nor true.
        if is_text(field) and not isinstance(value, str):
            wanted = F.lit(None).cast("string")
        elif isinstance(value, str) and (is_numeric(field) or isinstance(field.dataType, T.BooleanType)):
            wanted = F.lit(None).cast(field.dataType)
        elif not is_text(field) and isinstance(value, str):
            wanted = F.lit(value).try_cast(field.dataType)
    tests = {
        "eq": lambda: c == wanted,
        "ne": lambda: wanted.isNull() | ~c.eqNullSafe(wanted),
        "gt": lambda: c > wanted,
        "gte": lambda: c >= wanted,
        "lt": lambda: c < wanted,
        "lte": lambda: c <= wanted,
    }
    return df.filter(tests[operator]())


def drop_duplicates(
    df: DataFrame, mode: str = "all_first", subset=None, keep: str = "first", order_by=None
) -> DataFrame:
    """Duplicate removal by grouping, so copies collapse before the shuffle.

    ``all_first``/``all_last`` compare every column except the ``order_by`` keys that
    identify a row; without keys, equal rows are interchangeable. ``subset_keep`` keeps
    the first or last row per subset. ``drop_all`` removes every copy.
    """
    require_choice(mode, DEDUP_MODES, "mode")
    names = require_columns(df, as_list(subset))
    if mode == "subset_keep" and not names:
        raise ValueError("mode 'subset_keep' needs a subset")
    if mode in ("all_first", "all_last"):
        ids = require_columns(df, as_list(order_by))
        compared = [c for c in df.columns if c not in ids]
        if not ids:
            return df.dropDuplicates()
        keep = "first" if mode == "all_first" else "last"
        return _keep_one(df, compared, ids, keep)
    if mode == "subset_keep":
        require_choice(keep, ("first", "last"), "keep")
        return _keep_one(df, names, require_order(df, order_by), keep)
    keys = names or df.columns
    rest = [c for c in df.columns if c not in keys]
    aggregates = [F.count(F.lit(1)).alias("__copies")]
    if rest:
        aggregates.append(F.first(F.struct(*[col(c) for c in rest])).alias("__row"))
    single = df.groupBy(*[col(k) for k in keys]).agg(*aggregates).filter("__copies = 1")
    return single.select(
        *[col(c) if c in keys else F.col("__row").getField(c).alias(c) for c in df.columns]
    )


def _keep_one(df: DataFrame, compared, order, keep: str) -> DataFrame:
    rest = [c for c in df.columns if c not in compared]
    key = F.struct(*[col(k) for k in order])
    payload = F.struct(*[col(c) for c in rest]) if rest else F.lit(1)
    pick = F.min_by if keep == "first" else F.max_by
    grouped = df.groupBy(*[col(c) for c in compared]).agg(pick(payload, key).alias("__row"))
    return grouped.select(
        *[col(c) if c in compared else F.col("__row").getField(c).alias(c) for c in df.columns]
    )
