"""Small plan helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gristmill.plans.session import checkpoint


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def in_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded size.

    Sets two settings of the session: a batch holds at most a thousand rows and about 16 MB, so
    that neither the JVM's buffers nor the Python workers grow with the length of the texts.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Smallest reachable id for every id in ``edges(a, b)``: columns ``id, root``.

    Alternating large-star and small-star rounds: every edge list is no longer than the one
    before, copies vanish in partial aggregates, and the number of rounds grows with the
    logarithm of the longest path. Each round is written to the shared folder, so a lost
    executor costs a task and not the whole iteration. A vertex with very many neighbours is
    only ever reduced by ``min``, and its edges are split by adaptive skew handling.
    """
    pairs = checkpoint(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    for _ in range(rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = (
            both.join(least, "u").where("v > u AND v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
            .union(least.where("low < u").select("u", F.col("low").alias("v")))
            .distinct()
        )
        large = checkpoint(large)
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(least, "u").where("v <> low").select(F.greatest("v", "low").alias("u"), F.least("v", "low").alias("v"))
            .union(least.select("u", F.col("low").alias("v")))
            .distinct()
        )
        pairs = checkpoint(small)
        # Done when all are stars: who points somewhere does so once, and nobody points at it.
        seen = pairs.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("back")).union(
            pairs.select("v", F.lit(0), F.lit(1))
        )
        open_ends = seen.groupBy("id").agg(F.sum("out").alias("out"), F.max("back").alias("back"))
        if open_ends.where("out > 1 OR (out > 0 AND back > 0)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    tops = pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).union(tops)


def forest(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest connected number of each of ``n`` points."""
    label = np.arange(n)
    if not edges:
        return label
    i, j = (np.concatenate(z) for z in zip(*edges))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint after which Spark may drop the shuffle files of the finished step.

    Spark removes them when the driver's garbage is collected, which a driver that only plans
    does too rarely for steps that shuffle more than their result.
    """
    written = checkpoint(df)
    del df
    for _ in range(2):  # the first round lets go of what the second finds unused
        gc.collect()
        written.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(1)
    return written


SMALL_ROWS = 100_000
SMALL_BYTES = 16 << 20


def small(df: DataFrame) -> DataFrame:
    """Write a lookup table; mark it for broadcast only if rows and bytes are both checked small.

    A larger table keeps the join the optimizer picks, with adaptive skew splitting.
    """
    written = checkpoint(df)
    texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    wide = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(16 * len(df.columns)))
    rows, size = written.agg(F.count("*"), F.coalesce(F.sum(wide.cast("long")), F.lit(0))).first()
    return F.broadcast(written) if rows <= SMALL_ROWS and size <= SMALL_BYTES else written
