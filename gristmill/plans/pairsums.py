"""Sums over every pair of columns of a wide table, gathered as matrices per task.

A row per pair of columns for each input row, or a scan per few pairs, does not survive a wide
table. Here a task multiplies blocks of rows as matrices, or counts them by code, and hands on
one number per pair (or per cell of a pair's contingency table); Spark adds those up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_ROWS = 65_536
BLOCK_BYTES = 64 << 20


def _blocks(batches, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES):
    """Arrow batches gathered into tables of bounded rows and bytes."""
    held, count, used = [], 0, 0
    for batch in batches:
        held.append(batch)
        count, used = count + batch.num_rows, used + batch.nbytes
        if count >= rows or used >= size:
            yield pa.Table.from_batches(held)
            held, count, used = [], 0, 0
    if count:
        yield pa.Table.from_batches(held)


def _moments(width: int):
    """A task's sums for all ordered pairs of columns; it holds six numbers per pair."""

    def run(batches):
        counts, sums, squares, products = (np.zeros((width, width)) for _ in range(4))
        least, greatest = np.full((width, width), np.inf), np.full((width, width), -np.inf)
        seen = False
        for block in _blocks(batches):
            seen = True
            columns = [block.column(i) for i in range(width)]
            here = np.column_stack([c.is_valid().to_numpy() for c in columns])
            x = np.column_stack([c.to_numpy() for c in columns])
            x = np.where(here, x, 0.0)
            present = here.astype(float)
            counts += present.T @ present
            sums += x.T @ present
            squares += (x * x).T @ present
            products += x.T @ x
            low, high = np.where(here, x, np.inf), np.where(here, x, -np.inf)
            whole = here.all(axis=0)
            for extreme, values, merge in ((least, low, np.minimum), (greatest, high, np.maximum)):
                extreme[:, whole] = merge(extreme[:, whole], merge.reduce(values, axis=0)[:, None])
                for b in np.flatnonzero(~whole & here.any(axis=0)):
                    extreme[:, b] = merge(extreme[:, b], merge.reduce(values[here[:, b]], axis=0))
        if seen:
            i, j = np.divmod(np.arange(width * width, dtype=np.int32), width)
            numbers = [m.reshape(-1) for m in (counts, sums, squares, least, greatest, products)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (i.astype(np.int32), j.astype(np.int32), *numbers)],
                names=["i", "j", "n", "s", "q", "lo", "hi", "p"],
            )

    return run


def pair_moments(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """``(i, j, n, s, q, lo, hi, p)`` for all ordered pairs of numeric ``values``, in one scan.

    ``n`` rows hold both values; over these, ``s``, ``q``, ``lo`` and ``hi`` are the sum, square
    sum, minimum and maximum of value ``i``, and ``p`` sums the products. Values near zero
    (centred ones) keep the digits. No row comes out of an empty table.
    """
    picked = df.select(*[v.cast("double").alias(f"x{i}") for i, v in enumerate(values)])
    parts = picked.mapInArrow(
        _moments(len(values)), "i int, j int, n double, s double, q double, lo double, hi double, p double"
    )
    return parts.groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in "nsq"], F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("p").alias("p")
    )


def _cells(width: int):
    """The cells of all contingency tables, counted per block of rows by the codes of the block."""

    def run(batches):
        for block in _blocks(batches):
            coded = [block.column(i).combine_chunks().dictionary_encode() for i in range(width)]
            codes = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in coded]
            texts = [c.dictionary.cast(pa.string()) for c in coded]
            for i in range(width - 1):
                for j in range(i + 1, width):
                    wide = len(texts[j])
                    key = codes[i] * wide + codes[j]
                    if len(texts[i]) * wide <= 4 * len(key):
                        counts = np.bincount(key)
                        cells = np.flatnonzero(counts)
                        counts = counts[cells]
                    else:
                        cells, counts = np.unique(key, return_counts=True)
                    of_pair = np.ones(len(cells), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(of_pair * np.int32(i)),
                            pa.array(of_pair * np.int32(j)),
                            texts[i].take(pa.array(cells // wide)),
                            texts[j].take(pa.array(cells % wide)),
                            pa.array(counts.astype(np.int64)),
                        ],
                        names=["i", "j", "a", "b", "o"],
                    )

    return run


def pair_cells(df: DataFrame, texts: Sequence[Column]) -> DataFrame:
    """``(i, j, a, b, o)``: how many rows hold ``a`` in text ``i`` and ``b`` in text ``j``, for i < j.

    One scan. The texts must not be null. A block of rows is counted in its task, so what is
    shuffled follows the cells of the blocks and not the rows times the pairs.
    """
    picked = df.select(*[t.alias(f"c{i}") for i, t in enumerate(texts)])
    parts = picked.mapInArrow(_cells(len(texts)), "i int, j int, a string, b string, o long")
    return parts.groupBy("i", "j", "a", "b").agg(F.sum("o").cast("double").alias("o"))
