"""Distributions, frequencies, cross tables, missing values, pairs of columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gristmill.functions.moments import kurtosis_corrected, pearson, share, skew_corrected
from gristmill.functions.text import to_text
from gristmill.functions.types import (
    as_list,
    col,
    is_nested,
    numeric_columns,
    require_columns,
    require_numeric,
    require_order,
    require_range,
)
from gristmill.operators.profile import _long_counts, top_values
from gristmill.plans.pairsums import pair_moments
from gristmill.plans.stats import attach, stat, tidy, with_distinct_counts

BINS, MAX_BINS = 20, 100
TOP_N, MAX_TOP_N = 20, 100
CROSSTAB_LABELS = 50
SAMPLE, MAX_SAMPLE = 500, 5_000
SEED = 42
WORST_ROWS = 10
CO_NULL = 0.5
PAIRS_PER_JOB = 200


def sample_order(keys) -> Column:
    """A reproducible random order: the hash of the row key and the seed."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys])
    return F.md5(F.concat(text, F.lit(f":{SEED}")))


def distribution_stats(df: DataFrame, columns) -> DataFrame:
    """Moments of each column; skewness and kurtosis are corrected for bias."""
    names = require_numeric(df, as_list(columns))
    aggregates = []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        aggregates += [
            F.count(c).alias(f"n{i}"),
            F.avg(c).alias(f"mean{i}"),
            F.stddev_samp(c).alias(f"std{i}"),
            F.min(c).alias(f"min{i}"),
            F.max(c).alias(f"max{i}"),
            F.skewness(c).alias(f"skew{i}"),
            F.kurtosis(c).alias(f"kurt{i}"),
        ]
    rows = []
    for i, n in enumerate(names):
        spread = F.col(f"max{i}") - F.col(f"min{i}")
        rows.append(
            {
                "column": F.lit(n),
                "count": F.col(f"n{i}"),
                "mean": F.round(f"mean{i}", 4),
                "std": F.round(f"std{i}", 4),
                "min": F.round(f"min{i}", 4),
                "max": F.round(f"max{i}", 4),
                "skewness": F.round(
                    skew_corrected(F.col(f"n{i}"), F.col(f"skew{i}"), spread), 4
                ),
                "kurtosis": F.round(
                    kurtosis_corrected(F.col(f"n{i}"), F.col(f"kurt{i}"), spread), 4
                ),
            }
        )
    return tidy(df.agg(*aggregates), rows)


def distribution_bins(df: DataFrame, columns, bins: int = BINS) -> DataFrame:
    """Equal-width histogram with a closed last bin; empty bins are reported with 0."""
    names = require_numeric(df, as_list(columns))
    require_range(bins, 1, MAX_BINS, "bins")
    ranges = df.agg(
        *[F.min(col(n).cast("double")).alias(f"lo{i}") for i, n in enumerate(names)],
        *[F.max(col(n).cast("double")).alias(f"hi{i}") for i, n in enumerate(names)],
    )
    edges = []
    for i in range(len(names)):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        infinite = (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf"))
        low = F.when(infinite, F.raise_error(F.lit("values must be finite")).cast("double"))
        edges += [
            low.when(lo == hi, lo - 0.5).otherwise(lo).alias(f"from{i}"),
            F.when(lo == hi, hi + 0.5).otherwise(hi).alias(f"to{i}"),
        ]
    ranges = ranges.select(*edges)
    marked = attach(df.select(*[col(n) for n in names]), ranges)
    entries = []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        width = (stat(f"to{i}") - stat(f"from{i}")) / bins
        place = F.least(F.floor((c - stat(f"from{i}")) / width), F.lit(bins - 1).cast("long"))
        # ``least`` skips nulls, so a missing value needs its own branch.
        place = F.when(c.isNotNull(), place)
        entries.append(F.struct(F.lit(n).alias("column"), place.cast("int").alias("bin")))
    counted = (
        marked.select(F.inline(F.array(*entries)))
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .count()
    )
    frames = tidy(
        ranges,
        [
            {"column": F.lit(n), "low": F.col(f"from{i}"), "high": F.col(f"to{i}")}
            for i, n in enumerate(names)
        ],
    ).filter(F.col("low").isNotNull())
    width = (F.col("high") - F.col("low")) / bins
    all_bins = frames.select(
        "column", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    # Both sides hold at most columns x bins rows.
    joined = all_bins.join(F.broadcast(counted), ["column", "bin"], "left")
    return joined.select(
        "column",
        F.col("bin").cast("long").alias("bin"),
        F.round(F.col("low") + F.col("bin") * width, 4).alias("range_start"),
        F.round(
            F.when(F.col("bin") == bins - 1, F.col("high")).otherwise(
                F.col("low") + (F.col("bin") + 1) * width
            ),
            4,
        ).alias("range_end"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
    )


def _frequency_fields(df: DataFrame, columns, max_columns: int | None = None):
    names = require_columns(df, as_list(columns))
    if names:
        return [df.schema[n] for n in names]
    return [f for f in df.schema if not is_nested(f)][:max_columns]


def value_counts(df: DataFrame, columns=None, top_n: int = TOP_N, max_columns: int | None = None) -> DataFrame:
    """The most frequent values per column, null included, with their share of all rows.

    ``max_columns`` keeps the first columns only; without it every column is reported.
    """
    require_range(top_n, 1, MAX_TOP_N, "top_n")
    fields = _frequency_fields(df, columns, max_columns)
    top = top_values(_long_counts(df, fields, keep_null=True), top_n)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return attach(top, total).select(
        "column",
        "value",
        "count",
        share(F.col("count"), stat("total"), 2).alias("pct"),
        F.col("rank").cast("long").alias("rank"),
    )


def value_counts_meta(df: DataFrame, columns=None, approx: bool = False, max_columns: int | None = None) -> DataFrame:
    """Rows, nulls and distinct values per column."""
    fields = _frequency_fields(df, columns, max_columns)
    stats = [F.count(F.lit(1)).alias("total"), *[F.count(col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)]]
    if approx:
        stats = df.agg(*stats, *[F.approx_count_distinct(col(f.name)).alias(f"u{i}") for i, f in enumerate(fields)])
    else:
        stats = with_distinct_counts(df.agg(*stats), df, [f.name for f in fields])
    return tidy(
        stats,
        [
            {
                "column": F.lit(f.name),
                "total_rows": F.col("total"),
                "null_count": F.col("total") - F.col(f"c{i}"),
                "unique_count": F.col(f"u{i}"),
            }
            for i, f in enumerate(fields)
        ],
    )


def crosstab(df: DataFrame, a: str, b: str, normalize: bool = False) -> DataFrame:
    """Tidy cross table ``(a, b, n)`` with every combination, zero included.

    More than 50 labels on an axis is an error. Rows null in either column do not count.
    ``n`` is the row share when ``normalize`` is set.
    """
    require_columns(df, [a, b])
    if a == b:
        raise ValueError("choose two different columns")
    av, bv = to_text(df.schema[a]).alias("a"), to_text(df.schema[b]).alias("b")
    cells = df.select(av, bv).filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").count()
    limit = CROSSTAB_LABELS
    # The label list is gathered only when the axis is within the limit.
    axes = cells.agg(F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
    labels = attach(cells.select("b").distinct(), axes).filter(stat("nb") <= limit)
    labels = labels.agg(F.collect_list("b").alias("bs"))
    rows = attach(attach(cells.select("a").distinct(), axes), labels, "labels")
    checked = F.when(
        (stat("na") > limit) | (stat("nb") > limit),
        F.raise_error(F.lit(f"cross table supports at most {limit} labels per axis")).cast(
            "array<string>"
        ),
    ).otherwise(F.col("labels.bs"))
    grid = rows.select("a", F.explode(checked).alias("b"))
    # At most 50 x 50 cells: more labels are an error before the join is read.
    full = grid.join(F.broadcast(cells), ["a", "b"], "left").select(
        "a", "b", F.coalesce("count", F.lit(0).cast("long")).alias("n")
    )
    if not normalize:
        return full
    totals = cells.groupBy("a").agg(F.sum("count").alias("t"))
    # At most 50 rows: the axis limit is enforced above.
    return full.join(F.broadcast(totals), "a").select(
        "a", "b", F.round(F.col("n") / F.col("t"), 4).alias("n")
    )


def crosstab_wide(df: DataFrame, a: str, b: str, normalize: bool = False) -> DataFrame:
    """The cross table with one column per label of ``b`` (at most 50)."""
    cells = crosstab(df, a, b, normalize)
    labels = sorted(r["b"] for r in cells.select("b").distinct().collect())
    return cells.groupBy("a").pivot("b", labels).agg(F.first("n")).withColumnRenamed("a", a)


def missing_by_column(df: DataFrame) -> DataFrame:
    stats = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
    )
    return tidy(
        stats,
        [
            {
                "column": F.lit(c),
                "null_count": F.col("total") - F.col(f"c{i}"),
                "null_pct": share(F.col("total") - F.col(f"c{i}"), F.col("total"), 2),
            }
            for i, c in enumerate(df.columns)
        ],
    )


def missing_worst_rows(df: DataFrame, order_by, limit: int = WORST_ROWS) -> DataFrame:
    """The rows with the most nulls."""
    keys = require_order(df, order_by)
    nulls = F.lit(0).cast("long")
    for c in df.columns:
        nulls = nulls + F.when(col(c).isNull(), 1).otherwise(0)
    counted = df.select(*[col(k) for k in keys], nulls.alias("null_count"))
    return (
        counted.filter("null_count > 0")
        .orderBy(F.col("null_count").desc(), *[col(k) for k in keys])
        .limit(limit)
    )


def co_null_pairs(df: DataFrame) -> DataFrame:
    """Pairs of columns whose null patterns correlate with |r| of at least 0.5.

    One scan. Many columns are counted as matrices of null flags, few as plain aggregates.
    """
    names = sorted(df.columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        raise ValueError("co-null pairs need at least two columns")
    if len(pairs) > PAIRS_PER_JOB:
        rows = _co_null_matrix(df, names)
    else:
        stats = df.agg(
            *[
                F.round(pearson(col(a).isNull().cast("int"), col(b).isNull().cast("int")), 3).alias(f"r{k}")
                for k, (a, b) in enumerate(pairs)
            ]
        )
        rows = tidy(
            stats,
            [{"column_a": F.lit(a), "column_b": F.lit(b), "r": F.col(f"r{k}")} for k, (a, b) in enumerate(pairs)],
        )
    return rows.filter(F.abs("r") >= CO_NULL)


def _co_null_matrix(df: DataFrame, names) -> DataFrame:
    """``(column_a, column_b, r)`` from how often two columns are null together."""
    together = pair_moments(df, [col(n).isNull().cast("int") for n in names])
    # One row per column.
    alone = together.filter("i = j").select("i", (F.col("s") / F.col("n")).alias("share"))
    of_a = F.broadcast(alone.withColumnRenamed("share", "pa"))
    of_b = F.broadcast(alone.select(F.col("i").alias("j"), F.col("share").alias("pb")))
    pa, pb = F.col("pa"), F.col("pb")
    spread = F.sqrt(pa * (1 - pa)) * F.sqrt(pb * (1 - pb))
    r = F.try_divide(F.col("p") / F.col("n") - pa * pb, F.nullif(spread, F.lit(0.0)))
    listed = F.array(*[F.lit(n) for n in names])
    return (
        together.filter("i < j").join(of_a, "i").join(of_b, "j")
        .select(F.get(listed, "i").alias("column_a"), F.get(listed, "j").alias("column_b"), F.round(r, 3).alias("r"))
    )


def paired_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of many column pairs, each over its own complete rows.

    Two scans of plain sums: the first finds counts, means and extremes, the second sums
    products around those means, as one aggregate for few pairs and as matrices for many.
    A column without nulls shares its own sums among all its pairs. Only a few numbers per
    pair reach the driver.
    """
    names = list(dict.fromkeys(n for pair in pairs for n in pair))
    x = {n: col(n).cast("double") for n in names}
    first = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(x[n]).alias(f"c{i}") for i, n in enumerate(names)],
        *[F.avg(x[n]).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.min(x[n]).alias(f"lo{i}") for i, n in enumerate(names)],
        *[F.max(x[n]).alias(f"hi{i}") for i, n in enumerate(names)],
    ).first()
    at = {n: i for i, n in enumerate(names)}
    full = {n: first[f"c{at[n]}"] == first["n"] for n in names}
    varies = {n: first[f"c{at[n]}"] > 0 and first[f"lo{at[n]}"] < first[f"hi{at[n]}"] for n in names}
    d = {n: x[n] - F.lit(first[f"m{at[n]}"]).cast("double") for n in names}
    wanted = [p for p in pairs if varies[p[0]] and varies[p[1]]]
    if not wanted:
        return dict.fromkeys(pairs)
    if len(wanted) > PAIRS_PER_JOB:
        found = _sums_of_many(df, d, wanted)
    else:
        found = _sums_of_few(df, x, d, full, at, wanted)
    return {**dict.fromkeys(pairs), **{p: _r_of_sums(*found[p]) for p in wanted}}


def _sums_of_few(df: DataFrame, x, d, full, at, pairs) -> dict:
    """Per pair: count, sums, square sums, "is constant" of both sides and the sum of products."""
    sums: dict[str, Column] = {}

    def side(a, b):
        """Names of count, sum, square sum, min and max of ``a`` where ``b`` is present."""
        tag = f"{at[a]}" if full[b] else f"{at[a]}_{at[b]}"
        present = d[a] if full[b] else F.when(x[b].isNotNull(), d[a])
        sums.setdefault(f"n{tag}", F.count(present))
        sums.setdefault(f"s{tag}", F.sum(present))
        sums.setdefault(f"q{tag}", F.sum(present * present))
        sums.setdefault(f"l{tag}", F.min(present))
        sums.setdefault(f"h{tag}", F.max(present))
        return tag

    tags = {}
    for a, b in pairs:
        tags[a, b] = side(a, b), side(b, a)
        sums[f"p{at[a]}_{at[b]}"] = F.sum(d[a] * d[b])
    row = df.agg(*[e.alias(k) for k, e in sums.items()]).first()

    def of(tag):
        return row[f"s{tag}"], row[f"q{tag}"], row[f"l{tag}"] == row[f"h{tag}"]

    return {
        (a, b): (row[f"n{tags[a, b][0]}"], of(tags[a, b][0]), of(tags[a, b][1]), row[f"p{at[a]}_{at[b]}"])
        for a, b in pairs
    }


def _sums_of_many(df: DataFrame, d, pairs) -> dict:
    """The same numbers from matrices over all columns that the pairs name."""
    names = list(dict.fromkeys(n for pair in pairs for n in pair))
    at = {n: i for i, n in enumerate(names)}
    rows = {(r["i"], r["j"]): r for r in pair_moments(df, [d[n] for n in names]).collect()}

    def of(r):
        return r["s"], r["q"], r["lo"] == r["hi"]

    out = {}
    for a, b in pairs:
        ab, ba = rows[at[a], at[b]], rows[at[b], at[a]]
        out[a, b] = ab["n"], of(ab), of(ba), ab["p"]
    return out


def _r_of_sums(n, first, second, products) -> float | None:
    (sa, qa, constant_a), (sb, qb, constant_b) = first, second
    if not n or constant_a or constant_b:
        return None
    va, vb = qa - sa**2 / n, qb - sb**2 / n
    cov = products - sa * sb / n
    return cov / (math.sqrt(va) * math.sqrt(vb)) if va > 0 and vb > 0 else None


def matrix_rows(spark, names, found: dict[tuple[str, str], float | None]) -> DataFrame:
    """Tidy matrix ``(column_a, column_b, r)`` from one triangle, 4 digits."""
    rows = []
    for i, a in enumerate(names):
        for b in names[i:]:
            r = found[a, b]
            r = None if r is None else max(-1.0, min(1.0, r))
            rows.append((a, b, r))
            if a != b:
                rows.append((b, a, r))
    matrix = spark.createDataFrame(rows, "column_a string, column_b string, r double")
    return matrix.withColumn("r", F.round("r", 4))


def correlation_pearson(df: DataFrame, columns=None) -> DataFrame:
    """Matrix rows ``(column_a, column_b, r)`` over pairwise complete rows, 4 digits.

    The correlation with a constant is null, also on the diagonal.
    """
    names = require_numeric(df, as_list(columns)) or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return matrix_rows(df.sparkSession, names, paired_correlations(df, pairs))


def pairwise_r(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: complete rows and their correlation, null below three rows."""
    require_numeric(df, [x, y])
    both = col(x).isNotNull() & col(y).isNotNull()
    stats = df.agg(F.count_if(both).alias("n"), pearson(col(x), col(y)).alias("r"))
    return stats.select("n", F.when(F.col("n") >= 3, F.round("r", 4)).alias("r"))


def pairwise_points(df: DataFrame, x: str, y: str, order_by, sample: int = SAMPLE) -> DataFrame:
    """A reproducible random sample of the complete pairs."""
    require_numeric(df, [x, y])
    keys = require_order(df, order_by)
    require_range(sample, 1, MAX_SAMPLE, "sample")
    complete = df.filter(col(x).isNotNull() & col(y).isNotNull())
    shown = list(dict.fromkeys([*keys, x, y]))
    return (
        complete.select(*[col(c) for c in shown], sample_order(keys).alias("__order"))
        .orderBy("__order", *[col(k) for k in keys])
        .limit(sample)
        .select(*[col(k).alias(k) for k in keys], col(x).alias("x"), col(y).alias("y"))
    )
