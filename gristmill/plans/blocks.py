"""Pairwise work between two tables in blocks of bounded size.

The rows of both sides that share a cell are split by hash into blocks of about ``rows``
rows; each task gets one left and one right block and returns its reduced result, so no
pair is ever a row, and a crowded cell becomes many equal tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gristmill.plans.session import checkpoint

BLOCK_ROWS = 4_096
PACK_BLOCKS = 8


def fresh(df: DataFrame) -> DataFrame:
    """New column identities, for a cogroup whose sides derive from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _by_cell(fn):
    """Run ``fn`` once per cell of a pack of small cells."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lefts, rights = (side.groupby("__c").indices for side in (left, right))
        parts = [fn(left.iloc[rows], right.iloc[rights[c]]) for c, rows in lefts.items() if c in rights]
        return pd.concat(parts, ignore_index=True) if parts else fn(left.iloc[:0], right.iloc[:0])

    return run


def block_join(
    left: DataFrame,
    right: DataFrame,
    cell: Sequence[str],
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    rows: int | None = None,
) -> DataFrame:
    """Apply ``fn(left block, right block)`` to every pair of blocks within a cell.

    Cells that fit one block on both sides travel in packs, so that a table of many small
    cells is not a Python call per cell. Without cell columns the whole tables are one cell.
    """
    rows = rows or BLOCK_ROWS
    left, right = fresh(left), fresh(right)
    if not cell:
        return _whole(left, right, fn, schema, rows)
    named = F.to_json(F.struct(*cell))
    # Row counts per cell: read three times, small next to the tables.
    left_sizes = left.groupBy(named.alias("__c")).agg(F.count(F.lit(1)).alias("__nl"))
    right_sizes = right.groupBy(named.alias("__c")).agg(F.count(F.lit(1)).alias("__nr"))
    sizes = checkpoint(left_sizes.join(right_sizes, "__c"))
    total = sizes.agg(F.sum(F.col("__nl") + F.col("__nr"))).first()[0] or 0
    packs = max(1, -(-total // (PACK_BLOCKS * rows)))
    sizes = sizes.select(
        "__c",
        F.ceil(F.col("__nl") / rows).alias("__nl"),
        F.ceil(F.col("__nr") / rows).alias("__nr"),
    )
    place = F.when(
        (F.col("__nl") == 1) & (F.col("__nr") == 1),
        F.concat(F.lit("pack "), F.pmod(F.xxhash64("__c"), F.lit(packs)).cast("string")),
    ).otherwise(F.concat_ws(" ", "__c", "__i", "__j"))

    def spread(side: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        marked = side.withColumn("__c", named).withColumn("__h", F.xxhash64(*side.columns))
        return (
            marked.join(sizes, "__c")
            .withColumn(mine, F.pmod("__h", own))
            .withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
            .withColumn("__p", place)
            .select("__p", "__c", *side.columns)
        )

    lefts = spread(left, "__nl", "__nr", "__i", "__j")
    rights = spread(right, "__nr", "__nl", "__j", "__i")
    return lefts.groupBy("__p").cogroup(rights.groupBy("__p")).applyInPandas(_by_cell(fn), schema)


def _whole(left: DataFrame, right: DataFrame, fn, schema: str, rows: int) -> DataFrame:
    """Every block of one table with every block of the other; the two counts are literals."""
    blocks_l, blocks_r = max(1, -(-left.count() // rows)), max(1, -(-right.count() // rows))

    def spread(side: DataFrame, own: int, other: int, order: tuple[str, str]) -> DataFrame:
        mine, theirs = order
        return (
            side.withColumn(mine, F.pmod(F.xxhash64(*side.columns), F.lit(own)))
            .withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))))
            .select("__i", "__j", *side.columns)
        )

    lefts = spread(left, blocks_l, blocks_r, ("__i", "__j"))
    rights = spread(right, blocks_r, blocks_l, ("__j", "__i"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return fn(a.drop(columns=["__i", "__j"]), b.drop(columns=["__i", "__j"]))

    return lefts.groupBy("__i", "__j").cogroup(rights.groupBy("__i", "__j")).applyInPandas(run, schema)
