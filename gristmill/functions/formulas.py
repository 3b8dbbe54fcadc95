"""Two-operand arithmetic shared by the derived-column and formula operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gristmill.functions.types import require_choice

FORMULAS = ("divide", "multiply", "add", "subtract")
DIGITS = 10


def formula_value(formula: str, a: Column, b: Column) -> Column:
    """``a op b``; null where an operand is null, the denominator is zero or an integer overflows."""
    require_choice(formula, FORMULAS, "formula")
    if formula == "divide":
        return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    if formula == "multiply":
        return F.try_multiply(a, b)
    if formula == "add":
        return F.try_add(a, b)
    return F.try_subtract(a, b)


def formula_rounded(formula: str, a: Column, b: Column) -> Column:
    return F.round(formula_value(formula, a, b), DIGITS)
