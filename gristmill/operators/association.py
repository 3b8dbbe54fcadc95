"""Association between categorical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gristmill.functions.text import to_text
from gristmill.functions.types import as_list, is_nested, is_numeric, require_columns
from gristmill.plans.pairsums import pair_cells
from gristmill.plans.session import checkpoint, sized

PAIRS_PER_ROW = 200


def _cells_of_rows(df: DataFrame, texts) -> DataFrame:
    """``(i, j, a, b, o)`` for i < j, from the different rows and their weights."""
    width = len(texts)
    different = df.select(F.array(*texts).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("w"))

    def paired(i):
        return F.transform(
            F.sequence(i + 1, F.lit(width - 1)),
            lambda j: F.struct(i.alias("i"), j.alias("j"), F.get("c", i).alias("a"), F.get("c", j).alias("b")),
        )

    entries = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(width - 2)), paired))
    return (
        different.select("w", F.inline(entries))
        .groupBy("i", "j", "a", "b")
        .agg(F.sum("w").cast("double").alias("o"))
    )


def categorical_association(df: DataFrame, columns=None, max_columns: int | None = None) -> DataFrame:
    """Bias-corrected Cramer's V of every pair, rows ``(column_a, column_b, v)``.

    All named columns (or all that are neither numeric nor nested) take part unless
    ``max_columns`` keeps the first ones only. Null is a category. Two-by-two tables use the
    continuity correction. The cells of all pairs are counted in one scan: in a table of many
    columns by blocks of rows, else equal rows collapse into one with a weight before pairs are
    made of them. Everything after works on the contingency tables.
    """
    names = require_columns(df, as_list(columns))
    if not names:
        names = [f.name for f in df.schema if not is_numeric(f) and not is_nested(f)]
    names = names[:max_columns]
    if len(names) < 2:
        raise ValueError("association needs at least two categorical columns")
    width = len(names)
    texts = [F.coalesce(to_text(df.schema[n]), F.lit("nan")) for n in names]
    if width * (width - 1) // 2 > PAIRS_PER_ROW:
        counted = pair_cells(df, texts)
    else:
        counted = _cells_of_rows(df, texts)
    # Written once: the marginals and the sums over the cells read it.
    cells = checkpoint(counted)
    # Null is a category, so every pair has all rows and a column the same marginals in each.
    beside = cells.filter(F.col("j") == F.col("i") + 1)
    margins = sized(
        beside.select("o", F.col("i").alias("c"), F.col("a").alias("v"))
        .unionByName(beside.filter(F.col("j") == width - 1).select("o", F.col("j").alias("c"), F.col("b").alias("v")))
        .groupBy("c", "v")
        .agg(F.sum("o").alias("t"))
    )
    sizes = margins.groupBy("c").agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum("t").alias("n"), F.sum(1 / F.col("t")).alias("inverse")
    )
    of_a = margins.select(F.col("c").alias("i"), F.col("v").alias("a"), F.col("t").alias("ra"))
    of_b = margins.select(F.col("c").alias("j"), F.col("v").alias("b"), F.col("t").alias("cb"))
    # One row per column.
    first = F.broadcast(sizes.select(F.col("c").alias("i"), "n", F.col("k").alias("r"), F.col("inverse").alias("ia")))
    second = F.broadcast(sizes.select(F.col("c").alias("j"), "k", F.col("inverse").alias("ib")))
    expected = F.col("ra") * F.col("cb") / F.col("n")
    # In a 2x2 table all four gaps are equal, so an absent cell (observed 0) is covered by
    # scaling the mean squared gap with the sum of 1/expected over the full grid.
    table = (
        cells.join(of_a, ["i", "a"])
        .join(of_b, ["j", "b"])
        .join(first, "i")
        .groupBy("i", "j", "n", "r", "ia")
        .agg(
            F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("share"),
            F.max(F.abs(F.col("o") - expected)).alias("gap"),
        )
        .join(second, "j")
    )
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    corrected = F.col("gap") - F.least(F.col("gap"), F.lit(0.5))
    chi2 = F.when((r == 2) & (k == 2), corrected * corrected * n * F.col("ia") * F.col("ib")).otherwise(
        n * (F.col("share") - 1)
    )
    phi2 = F.greatest(F.lit(0.0), chi2 / n - F.try_divide((k - 1) * (r - 1), n - 1))
    rows_left = r - F.try_divide((r - 1) * (r - 1), n - 1)
    cols_left = k - F.try_divide((k - 1) * (k - 1), n - 1)
    smaller = F.least(cols_left - 1, rows_left - 1)
    v = F.sqrt(F.try_divide(phi2, F.nullif(smaller, F.lit(0.0))))
    v = F.coalesce(F.when(~F.isnan(v), F.round(v, 4)), F.lit(0.0))
    listed = F.array(*[F.lit(x) for x in names])
    label = F.struct(F.get(listed, F.col("i")).alias("a"), F.get(listed, F.col("j")).alias("b"))
    named = table.select(label.alias("l"), v.alias("v"))
    both = named.select(
        F.inline(
            F.array(
                F.struct(F.col("l.a").alias("column_a"), F.col("l.b").alias("column_b"), "v"),
                F.struct(F.col("l.b").alias("column_a"), F.col("l.a").alias("column_b"), "v"),
            )
        )
    )
    spark = df.sparkSession
    diagonal = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(x).alias("column_a"), F.lit(x).alias("column_b"), F.lit(1.0).alias("v")
                    )
                    for x in names
                ]
            )
        )
    )
    return both.unionByName(diagonal)
