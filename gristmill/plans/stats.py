"""One-row statistics that stay inside the plan.

A statistics frame has exactly one row (it is an aggregate without keys). It reaches
the data as a scalar subquery, so nothing is collected and no join is planned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gristmill.functions.types import col
from gristmill.plans.ordering import with_running_weight
from gristmill.plans.session import checkpoint

STATS = "__stats"
ACCURACY = 10_000
WHOLE_BRACKET = 200_000
SLACK = 4


def one_row(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    return df.agg(*[expr.alias(name) for name, expr in aggregates.items()])


def attach(df: DataFrame, stats: DataFrame, name: str = STATS) -> DataFrame:
    """Add the single row of ``stats`` to every row of ``df`` as a struct column."""
    packed = stats.select(F.struct(*[col(c) for c in stats.columns]).alias(name))
    return df.withColumn(name, packed.scalar())


def stat(name: str, holder: str = STATS) -> Column:
    return F.col(holder).getField(name)


def tidy(stats: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn the one-row ``stats`` into one row per entry of ``rows``."""
    structs = [F.struct(*[e.alias(n) for n, e in row.items()]) for row in rows]
    return stats.select(F.inline(F.array(*structs)))


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    ps: Sequence[float],
    approx: bool = False,
    accuracy: int = ACCURACY,
) -> dict[tuple[int, int], float | None]:
    """Exact linearly interpolated quantiles ``{(i, j): quantile ps[j] of columns[i]}``.

    The built-in exact ``percentile`` keeps every distinct value in one aggregation buffer.
    Here the table is read twice. The first scan takes counts, extremes and a mergeable sketch
    per column, which brackets each quantile; the second counts, for each bracket, the rows
    below it and every distinct value inside, and is written. Ranks are then found on that
    small table; a bracket that holds many values (of a quantile on the edge of heavy ones,
    say) is ranked in contiguous ranges. The sketch decides how much work is left, never the
    answer. Only a few numbers per column reach the driver; as literals they push down into the
    scans that use them.
    """
    values = df.select(
        *[col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    )
    every = range(len(columns))
    targets = [(i, j) for i in every for j in range(len(ps))]
    if approx:
        row = values.agg(
            *[F.percentile_approx(f"v{i}", list(ps), accuracy).alias(f"s{i}") for i in every]
        ).first()
        return {(i, j): row[f"s{i}"][j] if row[f"s{i}"] else None for i, j in targets}
    delta = SLACK / accuracy
    shares = [s for p in ps for s in (max(0.0, p - delta), min(1.0, p + delta))]
    row = values.agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in every],
        *[F.min(f"v{i}").alias(f"lo{i}") for i in every],
        *[F.max(f"v{i}").alias(f"hi{i}") for i in every],
        *[F.percentile_approx(f"v{i}", shares, accuracy).alias(f"s{i}") for i in every],
    ).first()
    position = {(i, j): (row[f"n{i}"] - 1) * ps[j] for i, j in targets if row[f"n{i}"]}
    if not position:
        return dict.fromkeys(targets)
    brackets: dict[tuple[int, float, float], int] = {}
    of = {}
    for i, j in position:
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        if row[f"n{i}"] > WHOLE_BRACKET:  # the quantiles of a short column rank the same values once
            low = low if shares[2 * j] == 0 else row[f"s{i}"][2 * j]
            high = high if shares[2 * j + 1] == 1 else row[f"s{i}"][2 * j + 1]
        of[i, j] = brackets.setdefault((i, low, high), len(brackets))
    number = F.lit(None).cast("double")
    entries = [
        F.when(F.col(f"v{i}") < low, F.struct(F.lit(k).alias("b"), number.alias("v"))).when(
            F.col(f"v{i}") <= high, F.struct(F.lit(k).alias("b"), F.col(f"v{i}").alias("v"))
        )
        for (i, low, high), k in brackets.items()
    ]
    counted = checkpoint(values.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("b", "v").count())
    below = {k: 0 for k in brackets.values()}
    inside = dict(below)
    longest = 0
    for r in counted.groupBy("b").agg(
        F.sum(F.when(F.col("v").isNull(), F.col("count"))).alias("below"),
        F.sum(F.when(F.col("v").isNotNull(), F.col("count"))).alias("inside"),
        F.count("v").alias("values"),
    ).collect():
        below[r["b"]], inside[r["b"]] = r["below"] or 0, r["inside"] or 0
        longest = max(longest, r["values"])
    for place, at in position.items():
        k = of[place]
        if math.floor(at) < below[k] or math.ceil(at) >= below[k] + inside[k]:
            raise ArithmeticError("a quantile bracket missed its rank; raise the sketch accuracy")
    held = counted.filter(F.col("v").isNotNull())
    if longest > WHOLE_BRACKET:
        ranked = with_running_weight(held, ["b"], "v", "count", "before").withColumn("upto", F.col("before") + F.col("count"))
    else:
        ranked = held.withColumn("upto", F.sum("count").over(Window.partitionBy("b").orderBy("v")))
    picks = []
    for (i, j), at in position.items():
        k = of[i, j]
        for name, rank in (("low", math.floor(at)), ("high", math.ceil(at))):
            wanted = (F.col("b") == k) & (F.col("upto") > rank - below[k])
            picks.append(F.min(F.when(wanted, F.col("v"))).alias(f"{name}{i}_{j}"))
    found = ranked.agg(*picks).first()
    out: dict[tuple[int, int], float | None] = dict.fromkeys(targets)
    for (i, j), at in position.items():
        low, high = found[f"low{i}_{j}"], found[f"high{i}_{j}"]
        out[i, j] = low if low == high else low + (high - low) * (at - math.floor(at))
    return out


def literal(value) -> Column:
    """A double literal, null for None."""
    return F.lit(value).cast("double")


def most_frequent(df: DataFrame, name: str) -> DataFrame:
    """One row: the most frequent non-null value, the smallest one on a tie."""
    counts = df.filter(col(name).isNotNull()).groupBy(col(name).alias("v")).count()
    return counts.agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("mode"))


def with_distinct_counts(stats: DataFrame, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``u0, u1, ...``: the exact number of different values of each column.

    Every column is counted by an aggregate of its own, which reads that column only. Counted
    together, each row would be copied once per column before the shuffle.
    """
    if not names:
        return stats
    counts = [
        df.agg(F.count_distinct(col(n)).alias("n")).select(F.lit(i).alias("i"), "n") for i, n in enumerate(names)
    ]
    listed = reduce(DataFrame.union, counts).agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
    held = attach(stats, listed, "__distinct")
    found = F.col("__distinct").getField("m")
    return held.select(*stats.columns, *[found.getItem(i).alias(f"u{i}") for i in range(len(names))])
