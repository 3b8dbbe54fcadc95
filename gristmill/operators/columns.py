"""Column operators: casts, renames, derived columns and cell edits."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gristmill.functions import casts as K
from gristmill.functions.formulas import formula_rounded
from gristmill.functions.moments import share
from gristmill.functions.text import float_to_string
from gristmill.functions.types import (
    LOGICAL_TYPE,
    MutationResult,
    as_list,
    col,
    is_datetime,
    is_float,
    is_integer,
    is_text,
    replace_columns,
    require_choice,
    require_columns,
    require_numeric,
    require_order,
)
from gristmill.plans.stats import attach, tidy

FIRST = "__first"


def _check_targets(df: DataFrame, targets: Mapping[str, str]) -> None:
    require_columns(df, list(targets))
    for target in targets.values():
        require_choice(target, K.TARGETS, "cast target")


def _with_first_values(df: DataFrame, names, order_by) -> DataFrame:
    """Attach the first non-null text of each column, which fixes its date format."""
    if not names:
        return df
    keys = require_order(df, order_by)
    key = F.struct(*[col(k) for k in keys])
    firsts = df.agg(
        *[F.min_by(col(n), F.when(col(n).isNotNull(), key)).alias(n) for n in names]
    )
    return attach(df, firsts, FIRST)


def _inferred_dates(df: DataFrame, targets, formats) -> list[str]:
    return [
        c for c, t in targets.items() if t == "datetime" and is_text(df.schema[c]) and not formats
    ]


def cast(
    df: DataFrame,
    targets: Mapping[str, str],
    order_by=None,
    formats=None,
    truncate: bool = False,
    keep_null: bool = False,
    parse: bool = False,
) -> DataFrame:
    """Convert columns; text that cannot be read as the target type becomes null.

    A text column cast to ``datetime`` is read in ONE format, that of its first value in
    ``order_by`` order, unless ``formats`` lists the formats to try.
    """
    _check_targets(df, targets)
    dates = _inferred_dates(df, targets, formats)
    prepared = _with_first_values(df, dates, order_by)
    exprs = {}
    for name, target in targets.items():
        field = df.schema[name]
        if target == "datetime":
            first = F.col(FIRST).getField(name) if name in dates else None
            exprs[name] = K.to_timestamp(field, formats, first)
        elif target in ("numeric", "float"):
            exprs[name] = K.to_double(field)
        elif target == "integer":
            exprs[name] = K.to_integer(field, truncate)
        elif target == "boolean":
            exprs[name] = K.to_boolean(field, parse)
        elif target == "string":
            exprs[name] = K.to_string(field, keep_null)
        else:
            exprs[name] = K.to_string(field, keep_null=True)
    columns = []
    for name in df.columns:
        if name not in exprs:
            columns.append(col(name))
        elif targets[name] == "category":
            columns.append(exprs[name].alias(name, metadata={LOGICAL_TYPE: "category"}))
        else:
            columns.append(exprs[name].alias(name))
    return prepared.select(*columns)


def _odd_boolean(field: T.StructField) -> Column:
    c = col(field.name)
    if is_text(field):
        return c.isNotNull() & ~c.isin("0", "1", "True", "False", "true", "false")
    if isinstance(field.dataType, T.NumericType):
        return c.isNotNull() & ~c.isin(0, 1)
    if isinstance(field.dataType, T.BooleanType):
        return F.lit(False)
    return c.isNotNull()


def validate_cast(df: DataFrame, targets: Mapping[str, str], order_by=None, formats=None) -> DataFrame:
    """Rows ``(column, target, status, message)`` from one aggregate over the table."""
    _check_targets(df, targets)
    dates = _inferred_dates(df, targets, formats)
    prepared = _with_first_values(df, dates, order_by)
    aggregates = {"total": F.count(F.lit(1))}
    rows = []
    for i, (name, target) in enumerate(targets.items()):
        field = df.schema[name]
        c = col(name)
        no = F.lit(False)
        fraction = odd = lost = null = no
        if target == "integer" and (is_float(field) or is_text(field)):
            fraction = K.has_fraction(field)
        if target == "string":
            null = c.isNull()
        if target == "boolean":
            odd = _odd_boolean(field)
        if target in ("numeric", "float", "integer"):
            lost = c.isNotNull() & K.to_double(field).isNull()
        if target == "datetime":
            first = F.col(FIRST).getField(name) if name in dates else None
            lost = c.isNotNull() & K.to_timestamp(field, formats, first).isNull()
        for kind, test in (("f", fraction), ("o", odd), ("l", lost), ("n", null)):
            aggregates[f"{kind}{i}"] = F.count_if(test)
        f, o, l, n = (F.col(f"{kind}{i}") for kind in "foln")
        lost_text = F.concat(
            l.cast("string"),
            F.lit(" cells, "),
            float_to_string(share(l, F.col("total"), 1)),
            F.lit(" percent of all rows, do not convert and turn null"),
        )
        broken = (f > 0) & F.lit(is_text(field))
        status = F.when(broken, "error").when(f + o + l + n > 0, "warning").otherwise("safe")
        message = (
            F.when(broken, "text with fractions cannot become integers")
            .when(f > 0, "fractions are cut off")
            .when(
                n > 0,
                F.concat(n.cast("string"), F.lit(" nulls turn into the text 'nan'")),
            )
            .when(
                o > 0,
                "some values are neither 0, 1, true nor false",
            )
            .when(l > 0, lost_text)
            .otherwise("every value converts")
        )
        rows.append(
            {"column": F.lit(name), "target": F.lit(target), "status": status, "message": message}
        )
    stats = prepared.agg(*[e.alias(n) for n, e in aggregates.items()])
    return tidy(stats, rows)


def _failing_integer_casts(df: DataFrame, targets: Mapping[str, str]) -> set[str]:
    """Columns whose integer cast would meet a fraction: one aggregate, one row collected."""
    names = [
        n
        for n, t in targets.items()
        if t == "integer" and (is_float(df.schema[n]) or is_text(df.schema[n]))
    ]
    if not names:
        return set()
    row = df.agg(
        *[F.max(K.has_fraction(df.schema[n])).alias(f"c{i}") for i, n in enumerate(names)]
    ).first()
    return {n for i, n in enumerate(names) if row[i]}


def cast_columns(
    df: DataFrame, targets: Mapping[str, str], force: bool = False, order_by=None, formats=None
) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """Validated casts: ``(table, applied casts, errors by column)``.

    A warning without ``force`` rejects the whole request. A column whose cast cannot
    work is left as it is; when no column can be cast the request fails.
    """
    report = {
        r["column"]: (r["status"], r["message"])
        for r in validate_cast(df, targets, order_by, formats).collect()
    }
    warnings = {c: m for c, (s, m) in report.items() if s == "warning"}
    if warnings and not force:
        raise ValueError(f"casts need confirmation (force=True): {warnings}")
    errors = {c: m for c, (s, m) in report.items() if s == "error"}
    for name in _failing_integer_casts(df, targets):
        errors.setdefault(name, "cannot safely cast fractions to integer")
    applied = {c: t for c, t in targets.items() if c not in errors}
    if not applied:
        raise ValueError(f"no column could be cast: {errors}")
    return cast(df, applied, order_by, formats), applied, errors


def apply_stored_casts(df: DataFrame, casts: Mapping[str, str], order_by=None, formats=None) -> DataFrame:
    """Re-apply remembered casts; columns that are gone or cannot be cast are skipped."""
    known = {c: t for c, t in casts.items() if c in df.columns and t in K.TARGETS}
    failing = _failing_integer_casts(df, known)
    return cast(df, {c: t for c, t in known.items() if c not in failing}, order_by, formats)


def rename_column(df: DataFrame, old: str, new: str, casts: Mapping[str, str] | None = None):
    """Rename; returns the table and the stored casts with their key moved."""
    require_columns(df, [old])
    if old == new:
        raise ValueError("the new name must differ from the old one")
    if not new or not new.strip():
        raise ValueError("the new name must not be blank")
    if new in df.columns:
        raise ValueError(f"column '{new}' already exists")
    moved = {new if c == old else c: t for c, t in (casts or {}).items()}
    return df.withColumnRenamed(old, new), moved


def drop_columns(df: DataFrame, names, casts: Mapping[str, str] | None = None):
    """Drop; returns the table and the stored casts without the dropped columns."""
    names = require_columns(df, as_list(names))
    kept = {c: t for c, t in (casts or {}).items() if c not in names}
    return df.drop(*names), kept


def add_column(df: DataFrame, new: str, formula: str, a: str, b: str) -> DataFrame:
    """New column from a two-operand formula, rounded to 10 digits."""
    require_numeric(df, [a, b])
    if new in df.columns:
        raise ValueError(f"column '{new}' already exists")
    return df.withColumn(new, formula_rounded(formula, col(a), col(b)))


def _renamed_all(df: DataFrame, rule) -> tuple[DataFrame, dict[str, str]]:
    names: dict[str, str] = {}
    taken: dict[str, str] = {}
    for old in df.columns:
        new = rule(old)
        if new in taken:
            raise ValueError(f"columns '{taken[new]}' and '{old}' both become '{new}'")
        taken[new] = old
        names[old] = new
    return df.toDF(*names.values()), names


def normalize_column_names(df: DataFrame, casts: Mapping[str, str] | None = None):
    """Lower-case word characters joined by ``_``; stored casts follow their column."""

    def snake(name):
        return re.sub(r"[^\w]+", "_", name.strip().lower()).strip("_")

    renamed, names = _renamed_all(df, snake)
    return renamed, {names.get(c, c): t for c, t in (casts or {}).items()}


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case, trimmed names with white space turned into ``_``."""
    return _renamed_all(df, lambda n: re.sub(r"\s+", "_", n.strip().lower()))[0]


def _typed_value(field: T.StructField, value, truncate: bool = False) -> Column:
    """A literal of the column's type, or an error when the value does not fit.

    A fraction does not fit an integer column unless ``truncate`` is set.
    """
    if value is None:
        return F.lit(None).cast(field.dataType)
    try:
        if isinstance(field.dataType, T.BooleanType):
            words = {"true": True, "1": True, "false": False, "0": False}
            return F.lit(words[str(value).strip().lower()])
        if is_integer(field):
            if not truncate and float(value) != int(float(value)):
                raise ValueError
            return F.lit(int(value if truncate or isinstance(value, (int, str)) else float(value))).cast(field.dataType)
        if is_float(field):
            return F.lit(float(value)).cast(field.dataType)
        if is_datetime(field):
            return F.lit(str(value)).cast(field.dataType)
        if is_text(field):
            return F.lit(str(value))
    except (KeyError, TypeError, ValueError):
        pass
    raise ValueError(f"value {value!r} does not fit column '{field.name}'")


def update_cell(df: DataFrame, key: Mapping[str, object], column: str, value) -> DataFrame:
    """Set one cell, addressed by the values of its key columns; an unknown key is an error."""
    require_columns(df, [*key, column])
    match = F.lit(True)
    for name, wanted in key.items():
        match = match & col(name).eqNullSafe(F.lit(wanted))
    if df.filter(match).isEmpty():
        raise ValueError(f"no row has the key {dict(key)}")
    new = _typed_value(df.schema[column], value, truncate=True)
    return replace_columns(df, {column: F.when(match, new).otherwise(col(column))})


def update_cells(df: DataFrame, patches: DataFrame, key: str, column: str) -> DataFrame:
    """Set many cells: ``patches`` holds ``(key, column)`` rows; a null patch sets null.

    Equal patches for one key count once, different ones are an error. The join strategy is
    left to the optimizer because the patch table may be large.
    """
    require_columns(df, [key, column])
    value = F.struct(col(column).cast(df.schema[column].dataType).alias("v"))
    unclear = F.raise_error(F.concat(F.lit("different patches for key "), F.col("__key").cast("string")))
    right = (
        patches.select(col(key).alias("__key"), value.alias("p"))
        .groupBy("__key")
        .agg(F.min("p").alias("low"), F.max("p").alias("high"))
        .select("__key", F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).otherwise(unclear.cast(f"struct<v:{df.schema[column].dataType.simpleString()}>")).alias("__patch"))
    )
    joined = df.join(right, col(key) == F.col("__key"), "left")
    patched = F.when(F.col("__patch").isNotNull(), F.col("__patch.v")).otherwise(col(column))
    return joined.select(*[patched.alias(c) if c == column else col(c) for c in df.columns])


def replace_values(
    df: DataFrame, mapping: Mapping, columns=None, confirm_global: bool = False
) -> MutationResult:
    """Exact replacement. Text keys match text columns, number keys number columns."""
    names = require_columns(df, as_list(columns))
    if not names:
        if not confirm_global:
            raise ValueError("name the columns, or pass confirm_global=True to search all")
        names = df.columns
    if not mapping:
        raise ValueError("the replacement mapping is empty")
    exprs, hits = {}, {}
    for name in names:
        field = df.schema[name]
        text = is_text(field)
        if not text and not isinstance(field.dataType, T.NumericType):
            continue
        usable = {
            old: new
            for old, new in mapping.items()
            if isinstance(old, str) == text and not isinstance(old, bool)
        }
        if not usable:
            continue
        c = col(name)
        hit = F.coalesce(c.isin(list(usable)), F.lit(False))
        swapped = c
        for old, new in usable.items():
            swapped = F.when(c == F.lit(old), _typed_value(field, new)).otherwise(swapped)
        exprs[name], hits[name] = swapped, hit
    counts = df.agg(
        *[F.count_if(h).alias(f"h{i}") for i, h in enumerate(hits.values())], F.lit(0).alias("none")
    )
    rows = [
        {"column": F.lit(n), "cells_replaced": F.col(f"h{i}") if n in hits else F.lit(0).cast("long")}
        for i, n in enumerate(hits)
    ] or [{"column": F.lit(None).cast("string"), "cells_replaced": F.lit(0).cast("long")}]
    return MutationResult(replace_columns(df, exprs), tidy(counts, rows))
