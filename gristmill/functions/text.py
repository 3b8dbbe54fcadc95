"""Text expressions whose results follow the data-frame conventions users know."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from gristmill.functions.types import col, is_float, is_integer


def float_to_string(c: Column) -> Column:
    """Plain digits from 1e-4 up to 1e16 (``1.0``, ``0.0001``), else ``1e-05``/``1e+16``."""
    c = c.cast("double")
    raw = c.cast("string")
    plain = raw.try_cast(T.DecimalType(38, 18)).cast("string")
    plain = F.regexp_replace(plain, "0+$", "")
    plain = F.regexp_replace(plain, r"\.$", ".0")
    mantissa = F.regexp_replace(F.split_part(raw, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(raw, F.lit("E"), F.lit(2)).try_cast("int")
    exponent = F.concat(
        mantissa,
        F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, "0").otherwise(""),
        F.abs(power).cast("string"),
    )
    size = F.abs(c)
    return (
        F.when(F.isnan(c), "nan")
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when(c == 0, "0.0")
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponent)
    )


def to_text(field: T.StructField, name: str | None = None) -> Column:
    """String form of a column, null kept."""
    c = col(name or field.name)
    if is_integer(field):
        return c.cast("string")
    if is_float(field):
        return F.when(c.isNotNull(), float_to_string(c))
    if isinstance(field.dataType, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def strip(c: Column) -> Column:
    """Remove all Unicode white space at both ends (``trim`` knows blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def title(c: Column) -> Column:
    """Capital letter after every non-letter, the rest lower."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))
        ),
        "",
    )
