"""Type-conversion expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from gristmill.functions.text import to_text
from gristmill.functions.types import (
    col,
    is_datetime,
    is_float,
    is_numeric,
    is_text,
)

TARGETS = {"datetime", "numeric", "float", "integer", "string", "boolean", "category"}

# Number texts that count as numeric.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"^\s*[+-]?(?i:inf|infinity)\s*$"

# Text shapes and the format each stands for, most specific first.
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$", "yyyy-M-d H:mm"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-M-d H:mm:ss[.SSSSSS][.SSS]"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d'T'H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
    (r"^(1[3-9]|2\d|3[01])-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "d/M/yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{8}$", "yyyyMMdd"),
]


def text_to_double(c: Column) -> Column:
    ok = c.rlike(NUMBER) | c.rlike(INFINITE)
    return F.when(ok, F.trim(c).try_cast("double"))


def to_double(field: T.StructField) -> Column:
    c = col(field.name)
    if is_text(field):
        return text_to_double(c)
    if isinstance(field.dataType, T.BooleanType) or is_numeric(field):
        return c.cast("double")
    if is_datetime(field):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return F.lit(None).cast("double")


def has_fraction(field: T.StructField) -> Column:
    value = to_double(field)
    return F.coalesce(value != F.rint(value), F.lit(False))


def to_integer(field: T.StructField, truncate: bool) -> Column:
    if not (is_text(field) or is_float(field)):
        return col(field.name).cast("long")
    value = to_double(field)
    whole = value.try_cast("long")
    if truncate:
        return whole
    message = F.lit(f"cannot cast column '{field.name}' to integer: it holds fractions")
    return F.when(has_fraction(field), F.raise_error(message).cast("long")).otherwise(whole)


def to_string(field: T.StructField, keep_null: bool) -> Column:
    text = to_text(field)
    return text if keep_null else F.coalesce(text, F.lit("nan"))


def to_boolean(field: T.StructField, parse: bool) -> Column:
    """Truthiness of the value; ``parse`` reads the words instead."""
    c = col(field.name)
    if parse:
        return c.try_cast("boolean") if is_text(field) else c.cast("boolean")
    if is_text(field):
        return F.coalesce(F.length(c) > 0, F.lit(False))
    if isinstance(field.dataType, T.BooleanType):
        return c
    if is_numeric(field):
        return F.coalesce(c != 0, F.lit(True))
    return F.lit(True)


def to_timestamp(field: T.StructField, formats=None, first: Column | None = None) -> Column:
    """Parse with the given formats, or with the one that the ``first`` value shows."""
    c = col(field.name)
    if is_datetime(field):
        return c.cast("timestamp")
    if is_numeric(field):
        return F.timestamp_micros(F.floor(c.cast("double") / 1000).cast("long"))
    if formats:
        return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
    chosen = None
    for shape, fmt in DATE_FORMATS:
        parsed = F.try_to_timestamp(c, F.lit(fmt))
        chosen = F.when(first.rlike(shape), parsed) if chosen is None else chosen.when(
            first.rlike(shape), parsed
        )
    return chosen.otherwise(c.try_cast("timestamp"))
