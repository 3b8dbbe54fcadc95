"""Order-dependent work without a single-partition window.

Rows are cut into contiguous key ranges by comparing each key with a short array of
sampled boundaries. The sample is chosen by hash, so the cut is the same in every
evaluation of the plan and after the loss of an executor. Work inside a range uses a
window partitioned by the range; what crosses ranges is a table of one row per range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gristmill.functions.types import col
from gristmill.plans.session import shuffle_partitions

BUCKET = "__bucket"
_BOUNDS = "__bounds"
SAMPLES_PER_BUCKET = 30


def key_struct(keys: Sequence[str]) -> Column:
    return F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def bucket_of(bounds: Column, key: Column, size: int) -> Column:
    """Number of sorted ``bounds`` that are <= key, by binary search in log2(size) steps."""
    steps = [1 << s for s in reversed(range(max(size, 1).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, step: F.when(F.get(bounds, pos + step - 1) <= key, pos + step).otherwise(pos),
    )


def with_buckets(df: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Add BUCKET: increasing with the keys, about equally filled."""
    buckets = buckets or shuffle_partitions(df.sparkSession)
    key = key_struct(keys)
    wanted = buckets * SAMPLES_PER_BUCKET
    # The share of the rows that yields about ``wanted`` of them; equal rows share one hash and
    # meet as one weighted key, so the list stays short whatever the data.
    whole = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(float(wanted)) / F.greatest("n", F.lit(1)))
    place = F.xxhash64(*[col(c) for c in df.columns]).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    sample = (
        df.select(key.alias("k"), place.alias("h"))
        .filter(F.col("h") <= whole.scalar())
        .groupBy("k")
        .agg(F.least(F.count(F.lit(1)), F.lit(wanted)).cast("int").alias("times"))
        .agg(F.sort_array(F.flatten(F.collect_list(F.array_repeat("k", F.col("times"))))).alias("s"))
    )
    last = F.size("s") - 1
    picks = F.sequence(F.lit(1), F.lit(buckets))
    bounds = sample.select(
        F.when(
            last >= buckets,
            F.transform(picks, lambda i: F.get("s", (last * i / F.lit(buckets)).cast("int"))),
        ).otherwise(F.col("s"))
    )
    return (
        df.withColumn(_BOUNDS, bounds.scalar())
        .withColumn(BUCKET, bucket_of(F.col(_BOUNDS), key, buckets + 1))
        .drop(_BOUNDS)
    )


def carried_by_bucket(
    bucketed: DataFrame, parts: Sequence[str], aggregates: dict, carry: Callable[[str, Window], Column]
) -> DataFrame:
    """Aggregate per (parts, bucket), then carry each result over the earlier buckets."""
    totals = bucketed.groupBy(*parts, BUCKET).agg(
        *[expr.alias(name) for name, expr in aggregates.items()]
    )
    earlier = (
        Window.partitionBy(*parts)
        .orderBy(BUCKET)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *parts, BUCKET, *[carry(name, earlier).alias(name) for name in aggregates]
    )


def with_row_number(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """0-based contiguous row numbers in key order."""
    bucketed = with_buckets(df, keys)
    offsets = carried_by_bucket(
        bucketed,
        [],
        {"__before": F.count(F.lit(1))},
        lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)),
    )
    local = Window.partitionBy(BUCKET).orderBy(*[col(k) for k in keys])
    # The offsets hold one row per bucket: at most buckets + 1 rows.
    return (
        bucketed.join(F.broadcast(offsets), BUCKET)
        .withColumn(name, F.col("__before") + F.row_number().over(local) - F.lit(1))
        .drop(BUCKET, "__before")
    )


def with_running_weight(
    df: DataFrame, parts: Sequence[str], value: str, weight: str, name: str
) -> DataFrame:
    """Sum of ``weight`` over the rows of the same part with a smaller ``value``."""
    bucketed = with_buckets(df, [*parts, value])
    offsets = carried_by_bucket(
        bucketed,
        list(parts),
        {"__before": F.sum(weight)},
        lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)),
    )
    local = (
        Window.partitionBy(BUCKET, *parts)
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per bucket and per part boundary inside a bucket: buckets + parts rows.
    return (
        bucketed.join(F.broadcast(offsets), [BUCKET, *parts])
        .withColumn(name, F.col("__before") + F.coalesce(F.sum(weight).over(local), F.lit(0)))
        .drop(BUCKET, "__before")
    )


def fill_along(df: DataFrame, columns: Sequence[str], keys: Sequence[str], backward: bool) -> DataFrame:
    """Replace nulls by the previous (or next) non-null value in key order."""
    bucketed = with_buckets(df, keys)
    key = key_struct(keys)  # a struct is never null, so a row with a null key counts too
    pick = F.min_by if backward else F.max_by
    carry = {
        f"__c{i}": pick(col(c), F.when(col(c).isNotNull(), key)) for i, c in enumerate(columns)
    }
    order = [F.col(BUCKET).desc()] if backward else [F.col(BUCKET)]
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy(BUCKET).agg(*[e.alias(n) for n, e in carry.items()])
    carried = totals.select(
        BUCKET, *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in carry]
    )
    sort = [col(k).desc() if backward else col(k) for k in keys]
    local = (
        Window.partitionBy(BUCKET).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = bucketed.join(F.broadcast(carried), BUCKET)
    filled = {
        c: F.coalesce(F.last(col(c), ignorenulls=True).over(local), F.col(f"__c{i}"))
        for i, c in enumerate(columns)
    }
    return joined.select(
        *[filled[c].alias(c) if c in filled else col(c) for c in df.columns]
    )


GROUP_LIMIT = 1_000
SALTS = 256


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, name: str) -> DataFrame:
    """The first ``n`` rows of each group with their 1-based rank.

    Up to 1,000 rows per group Spark applies the rank limit before the shuffle. Beyond
    that a hot group is first cut in salted parts, so no task sorts the whole group.
    """
    if n > GROUP_LIMIT:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(SALTS)))
        part = Window.partitionBy(*groups, "__salt").orderBy(*order)
        df = (
            salted.withColumn("__n", F.row_number().over(part))
            .filter(F.col("__n") <= n)
            .drop("__n", "__salt")
        )
    whole = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(name, F.row_number().over(whole)).filter(F.col(name) <= n)
