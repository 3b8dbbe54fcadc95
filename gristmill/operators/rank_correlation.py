"""Spearman and Kendall correlation of many column pairs in a fixed number of stages."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gristmill.functions.types import as_list, col, numeric_columns, require_numeric
from gristmill.operators.eda import matrix_rows
from gristmill.plans.ordering import bucket_of, with_running_weight
from gristmill.plans.session import BROADCAST_ROWS, checkpoint, shuffle_partitions

MAX_CUTS = 512
CLASS_POINTS = 250_000  # distinct points that one task counts


def _pairs(df: DataFrame, columns):
    names = require_numeric(df, as_list(columns)) or numeric_columns(df)
    if len(names) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    return names, list(combinations(range(len(names)), 2))


def _points(df: DataFrame, names, pairs) -> DataFrame:
    """Distinct complete points ``(pair, x, y, w)`` of every pair; copies become a weight."""
    entries = [
        F.when(
            col(names[i]).isNotNull() & col(names[j]).isNotNull(),
            F.struct(
                F.lit(k).alias("pair"),
                col(names[i]).cast("double").alias("x"),
                col(names[j]).cast("double").alias("y"),
            ),
        )
        for k, (i, j) in enumerate(pairs)
    ]
    return (
        df.select(F.inline(F.array_compact(F.array(*entries))))
        .groupBy("pair", "x", "y")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )


def _margins(points: DataFrame) -> DataFrame:
    """Weight of each value per pair and side (0 for x, 1 for y)."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("x").alias("v")),
        F.struct(F.lit(1).alias("side"), F.col("y").alias("v")),
    )
    return (
        points.select("pair", "w", F.inline(sides))
        .groupBy("pair", "side", "v")
        .agg(F.sum("w").alias("t"))
    )


def _matrix(rows: DataFrame, names, pairs, constant: DataFrame) -> DataFrame:
    """Both triangles from ``(pair, r)`` plus the diagonal, which is null for a constant."""
    labels = F.array(
        *[
            F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"))
            for i, j in pairs
        ]
    )
    label = F.get(labels, F.col("pair"))
    named = rows.select(label.alias("l"), F.round("r", 4).alias("r"))
    both = named.select(
        F.inline(
            F.array(
                F.struct(F.col("l.a").alias("column_a"), F.col("l.b").alias("column_b"), "r"),
                F.struct(F.col("l.b").alias("column_a"), F.col("l.a").alias("column_b"), "r"),
            )
        )
    )
    return both.unionByName(constant)


def _diagonal(df: DataFrame, names) -> DataFrame:
    stats = df.agg(
        *[(F.max(col(n)) > F.min(col(n))).alias(f"v{i}") for i, n in enumerate(names)]
    )
    one = [
        F.struct(
            F.lit(n).alias("column_a"),
            F.lit(n).alias("column_b"),
            F.when(F.col(f"v{i}"), F.lit(1.0)).alias("r"),
        )
        for i, n in enumerate(names)
    ]
    return stats.select(F.inline(F.array(*one)))


def correlation_spearman(df: DataFrame, columns=None) -> DataFrame:
    """Pearson correlation of average ranks over the complete rows of each pair.

    Ranks are computed on distinct values, around their mean. A column is ranked once for all its
    partners without nulls, and once more for each partner with nulls, whose gaps change the
    ranks. The rows of all pairs in long form take the rank of the side with fewer values, are
    summed per value of the other side, and only these sums meet the ranks of the other side.
    """
    names, _ = _pairs(df, columns)
    values = df.select(*[col(n).cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    row = values.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(f"v{i}").alias(f"c{i}") for i in range(len(names))],
        *[(F.max(f"v{i}") > F.min(f"v{i}")).alias(f"d{i}") for i in range(len(names))],
    ).first()
    # A constant correlates with nothing and is not ranked.
    differ = [i for i in range(len(names)) if row[f"d{i}"]]
    gaps = [row[f"c{i}"] < row["n"] for i in range(len(names))]
    rankings: dict[tuple[int, int | None], int] = {}
    pairs = {}
    for i in differ:
        for j in (j for j in differ if j >= i):
            ids = []
            for own, other in ((i, j), (j, i)):
                key = (own, other if gaps[other] and other != own else None)
                ids.append(rankings.setdefault(key, len(rankings)))
            pairs[i, j] = tuple(ids)

    found: dict[tuple[str, str], float | None] = {
        (a, b): None for i, a in enumerate(names) for b in names[i:]
    }
    if not rankings:
        return matrix_rows(df.sparkSession, names, found)
    # Written once: sampling the cuts, the carries and the ranks all read the distinct values.
    margins = checkpoint(_ranked_values(values, rankings, gaps))
    # One row per ranking.
    totals = margins.groupBy("ranking").agg(F.sum("t").alias("n"), F.count(F.lit(1)).alias("values"))
    below = with_running_weight(margins, ["ranking"], "v", "t", "below").join(F.broadcast(totals), "ranking")
    place = F.col("below") + (F.col("t") + 1) / 2 - (F.col("n") + 1) / 2
    ranks = checkpoint(below.select("ranking", "v", "t", "values", place.alias("rank")))
    spread, values_of = {}, {}
    for r in ranks.groupBy("ranking").agg(
        F.sum(F.col("t") * F.col("rank") * F.col("rank")).alias("s"), F.first("values").alias("values")
    ).collect():
        spread[r["ranking"]], values_of[r["ranking"]] = r["s"], r["values"]
    vary = {p for p, (a, b) in pairs.items() if spread.get(a) and spread.get(b)}
    sums = _rank_products(values, ranks, {p: pairs[p] for p in sorted(vary) if p[0] < p[1]}, values_of)
    for i, j in vary:
        a, b = pairs[i, j]
        r = 1.0 if i == j else sums[i, j] / (math.sqrt(spread[a]) * math.sqrt(spread[b]))
        found[names[i], names[j]] = r
    return matrix_rows(df.sparkSession, names, found)


def _long_rows(values: DataFrame, entries, names) -> DataFrame:
    """Each row once per entry, a tuple of columns ``v0, v1, ...`` or whole numbers, under ``names``."""
    numbers = sorted({e for entry in entries for e in entry if isinstance(e, int)})
    table = values.select("*", *[F.lit(n).alias(f"n{n}") for n in numbers])
    listed = ", ".join(
        "(" + ", ".join(f"n{e}" if isinstance(e, int) else e for e in entry) + f") AS `{k}`" for k, entry in enumerate(entries)
    )
    query = f"SELECT {', '.join(names)} FROM {{table}} UNPIVOT INCLUDE NULLS (({', '.join(names)}) FOR entry IN ({listed}))"
    return values.sparkSession.sql(query, table=table)


MASK_BITS = 62


def _ranked_values(values: DataFrame, rankings, gaps) -> DataFrame:
    """``ranking, v, t``: the distinct values of every ranking and their numbers of rows.

    The rows are counted once per column, by value and by which columns with gaps are present;
    the rankings of a column take from these counts those with their partner present.
    """
    bit = {j: divmod(k, MASK_BITS) for k, j in enumerate(sorted({j for _, j in rankings if j is not None}))}
    masks = [
        sum((F.col(f"v{j}").isNotNull().cast("long") * F.lit(1 << b) for j, (m, b) in bit.items() if m == part), F.lit(0).cast("long"))
        for part in range(-(-len(bit) // MASK_BITS))
    ]
    held = [f"m{part}" for part in range(len(masks))]
    owns = sorted({own for own, _ in rankings})
    table = values.select("*", *[mask.alias(name) for mask, name in zip(masks, held)])
    counted = (
        _long_rows(table, [(f"v{own}", own, *held) for own in owns], ["v", "own", *held])
        .filter(F.col("v").isNotNull())
        .groupBy("own", "v", *held)
        .agg(F.count(F.lit(1)).alias("t"))
    )

    def present(other):
        if other is None:
            return F.lit(True)
        part, b = bit[other]
        return F.col(f"m{part}").bitwiseAND(F.lit(1 << b)) != 0

    of = {own: [(k, other) for (o, other), k in rankings.items() if o == own] for own in owns}
    chosen = F.lit(None).cast("array<int>")
    for own, listed in of.items():
        ids = F.array(*[F.when(present(other), F.lit(k)) for k, other in listed])
        chosen = F.when(F.col("own") == own, ids).otherwise(chosen)
    return (
        counted.select("v", "t", F.explode(chosen).alias("ranking"))
        .filter(F.col("ranking").isNotNull())
        .groupBy("ranking", "v")
        .agg(F.sum("t").cast("double").alias("t"))
    )


def _rank_products(values: DataFrame, ranks: DataFrame, pairs, values_of) -> dict[tuple[int, int], float]:
    """The sum of the products of both ranks per pair of columns, one small row each.

    Rankings of few values are broadcast, together no more than ``BROADCAST_ROWS``; the rows of
    pairs with two longer ones collapse into weighted points before they are joined.
    """
    if not pairs:
        return {}
    sides, first = [], set()
    for (i, j), (a, b) in pairs.items():
        if values_of[a] > values_of[b]:
            i, j, a, b = j, i, b, a
        sides.append((i, j, a, b))
        first.add(a)
    small, room = [], BROADCAST_ROWS
    for a in sorted(first, key=lambda a: (values_of[a], a)):
        if values_of[a] > room:
            break
        small.append(a)
        room -= values_of[a]

    def long_form(part):
        """A row ``(pair, rx, x, ry, y)`` for each pair that a row of the table completes."""
        entries = [(f"v{sides[k][0]}", f"v{sides[k][1]}", k, sides[k][2], sides[k][3]) for k in part]
        return _long_rows(values, entries, ["x", "y", "pair", "rx", "ry"]).filter("x IS NOT NULL AND y IS NOT NULL")

    by_x = ranks.select(F.col("ranking").alias("rx"), F.col("v").alias("x"), F.col("rank").alias("cx"))
    by_y = ranks.select(F.col("ranking").alias("ry"), F.col("v").alias("y"), F.col("rank").alias("cy"))
    parts = []
    short = [k for k, side in enumerate(sides) if side[2] in small]
    long = [k for k, side in enumerate(sides) if side[2] not in small]
    if short:
        table = F.broadcast(by_x.filter(F.col("rx").isin(small)))
        parts.append(long_form(short).join(table, ["rx", "x"]).select("pair", "ry", "y", "cx"))
    if long:
        points = long_form(long).groupBy("pair", "rx", "x", "ry", "y").agg(F.count(F.lit(1)).alias("w"))
        parts.append(points.join(by_x, ["rx", "x"]).select("pair", "ry", "y", (F.col("cx") * F.col("w")).alias("cx")))
    halves = reduce(DataFrame.unionByName, parts).groupBy("pair", "ry", "y").agg(F.sum("cx").alias("cx"))
    rows = halves.join(by_y, ["ry", "y"]).groupBy("pair").agg(F.sum(F.col("cx") * F.col("cy")).alias("p")).collect()
    found = {r["pair"]: r["p"] for r in rows}
    return {p: found[k] for k, p in enumerate(pairs)}


def _every_pair(rows: DataFrame, pairs) -> DataFrame:
    """A pair without complete rows has no group; report it as null."""
    spark = rows.sparkSession
    ids = spark.range(len(pairs)).select(F.col("id").cast("int").alias("pair"))
    return ids.join(F.broadcast(rows), "pair", "left")


def discordant_weight(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i * w_j over the pairs with x_i < x_j and y_i > y_j.

    Sorted by (x, y), such a pair is an inversion of y. Inversions are counted bit by bit
    of the rank of y: a pair is decided at the highest bit where the ranks differ.
    """
    order = np.lexsort((y, x))
    rank = np.unique(y, return_inverse=True)[1].reshape(-1)[order].astype(np.int64)
    weight = np.asarray(w, dtype=float)[order]
    total = 0.0
    for bit in reversed(range(max(int(rank.max()), 1).bit_length())):
        by_prefix = np.argsort(rank >> (bit + 1), kind="stable")
        rank, weight = rank[by_prefix], weight[by_prefix]
        prefix = rank >> (bit + 1)
        one = (rank >> bit) & 1
        ones = np.cumsum(weight * one)
        start = np.r_[True, prefix[1:] != prefix[:-1]]
        group = np.cumsum(start) - 1
        base = np.r_[0.0, ones][np.flatnonzero(start)][group]
        total += float(np.sum((ones - base) * weight * (1 - one)))
    return total


def _local_discordance(group: pd.DataFrame) -> pd.DataFrame:
    d = discordant_weight(group["x"].to_numpy(), group["y"].to_numpy(), group["w"].to_numpy())
    return pd.DataFrame({"root": [group["root"].iloc[0]], "d": [d]})


def _discordance(points: DataFrame, cuts: int, limit: int) -> DataFrame:
    """``(root, d)``: discordant weight within each ``pair`` of ``points(root, pair, x, y, w)``.

    Both axes are cut at sampled quantiles; a cut value is a class of its own, so the classes
    between cuts stay near ``1/cuts`` of the distinct points however the data is skewed. A
    discordant pair lies in two different classes on both axes (counted by running sums over
    the class grid), or shares its x class, or shares its y class. Classes of at most ``limit``
    points are counted by one task each; larger ones are cut again as pairs of their own.
    """
    keys = ["root", "pair"]
    grid = [(i + 1) / (cuts + 1) for i in range(cuts)]
    bounds = points.groupBy("pair").agg(
        F.array_distinct(F.percentile_approx("x", grid, 10_000)).alias("bx"),
        F.array_distinct(F.percentile_approx("y", grid, 10_000)).alias("by"),
    )

    def cell(axis_bounds, value):
        place = bucket_of(axis_bounds, value, cuts)
        on_cut = F.get(axis_bounds, place - 1) == value
        return 2 * place - F.when(on_cut, 1).otherwise(0)

    placed = points.join(bounds, "pair").select(
        *keys, "x", "y", "w", cell(F.col("bx"), F.col("x")).alias("cx"), cell(F.col("by"), F.col("y")).alias("cy")
    )
    cells = placed.groupBy(*keys, "cx", "cy").agg(F.sum("w").alias("w"))
    dense = cells.select(*keys, "cx").distinct().select(
        *keys, "cx", F.explode(F.sequence(F.lit(0), F.lit(2 * cuts))).alias("cy")
    )
    dense = dense.join(cells, [*keys, "cx", "cy"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    above = Window.partitionBy("pair", "cx").orderBy(F.col("cy").desc()).rowsBetween(Window.unboundedPreceding, -1)
    left_of = Window.partitionBy("pair", "cy").orderBy("cx").rowsBetween(Window.unboundedPreceding, -1)
    across = (
        dense.withColumn("s", F.coalesce(F.sum("w").over(above), F.lit(0.0)))
        .withColumn("p", F.coalesce(F.sum("s").over(left_of), F.lit(0.0)))
        .groupBy("root")
        .agg(F.sum(F.col("p") * F.col("w")).alias("d"))
    )
    same_x = placed.filter("cx % 2 = 0").select(
        *keys, F.lit(0).alias("side"), F.col("cx").alias("class"), "x", "y", "w"
    )
    same_y = placed.filter("cy % 2 = 0").select(
        *keys, F.lit(1).alias("side"), F.col("cy").alias("class"), F.col("cx").cast("double").alias("x"), "y", "w"
    )
    name = F.concat_ws(" ", "pair", F.col("side").cast("string"), F.col("class").cast("string"))
    inside = checkpoint(
        same_x.unionByName(same_y).select("root", name.alias("pair"), "x", "y", "w")
        .groupBy("root", "pair", "x", "y").agg(F.sum("w").alias("w"))
    )
    sizes = checkpoint(inside.groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    large = sizes.filter(F.col("n") > limit).select("pair")
    if large.isEmpty():
        local, again = inside, None
    else:
        local = inside.join(sizes.filter(F.col("n") <= limit).select("pair"), "pair", "left_semi")
        again = _discordance(inside.join(large, "pair", "left_semi").select("root", "pair", "x", "y", "w"), cuts, limit)
    counted = local.groupBy("root", "pair").applyInPandas(_local_discordance, "root int, d double")
    parts = across.unionByName(counted)
    parts = parts if again is None else parts.unionByName(again)
    return parts.groupBy("root").agg(F.sum("d").alias("d"))


def correlation_kendall(df: DataFrame, columns=None, cuts: int | None = None, limit: int = CLASS_POINTS) -> DataFrame:
    """Kendall's tau-b, exact; see ``_discordance`` for how the work is cut."""
    names, pairs = _pairs(df, columns)
    cuts = cuts or min(MAX_CUTS, max(16, 2 * shuffle_partitions(df.sparkSession)))
    # Written once: the cuts, the class grid, the classes and the ties all read it.
    points = checkpoint(_points(df, names, pairs))
    named = points.select(F.col("pair").alias("root"), F.col("pair").cast("string").alias("pair"), "x", "y", "w")
    discordant = _discordance(named, cuts, limit).withColumnRenamed("root", "pair")
    ties = _margins(points).groupBy("pair").agg(
        F.sum(F.when(F.col("side") == 0, F.col("t") * (F.col("t") - 1) / 2)).alias("n1"),
        F.sum(F.when(F.col("side") == 1, F.col("t") * (F.col("t") - 1) / 2)).alias("n2"),
    )
    sizes = points.groupBy("pair").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("n3")
    )
    # All three tables hold one row per pair of columns.
    joined = sizes.join(F.broadcast(ties), "pair").join(F.broadcast(discordant), "pair")
    n0 = F.col("n") * (F.col("n") - 1) / 2
    concordant = n0 - F.col("n1") - F.col("n2") + F.col("n3") - F.col("d")
    spread = F.sqrt(n0 - F.col("n1")) * F.sqrt(n0 - F.col("n2"))
    tau = F.try_divide(concordant - F.col("d"), F.nullif(spread, F.lit(0.0)))
    found = _every_pair(joined.select("pair", tau.alias("r")), pairs)
    return _matrix(found, names, pairs, _diagonal(df, names))
