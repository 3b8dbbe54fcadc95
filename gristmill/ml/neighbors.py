"""Exact k-nearest-neighbour classification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gristmill.functions.types import as_list, col, require_numeric, require_order
from gristmill.plans.blocks import block_join
from gristmill.plans.ordering import bucket_of
from gristmill.plans.session import checkpoint
from gristmill.plans.stats import attach, stat

NEIGHBORS = 5
GRID_AXES = 3
MAX_CELLS = 4_096
ROWS_PER_CELL = 2_000


def _cuts(train: DataFrame, dims: int, rows: int):
    """How many quantile cuts each grid axis gets: at most MAX_CELLS cells in all."""
    axes = min(dims, GRID_AXES)
    wanted = max(1, min(MAX_CELLS, rows // ROWS_PER_CELL))
    return axes, max(1, int(round(wanted ** (1 / axes))))


def _nearest_cells(boxes: pd.DataFrame, k: int):
    """Cells that can hold one of the k nearest points, from bounding boxes and counts alone."""
    low, high = np.vstack(boxes["low"]), np.vstack(boxes["high"])
    count = boxes["n"].to_numpy(dtype=np.int64)
    cell = boxes["cell"].to_numpy(dtype=np.int64)

    def run(batches):
        for batch in batches:
            tests, cells = [], []
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                v = np.vstack(part["v"])
                near = np.zeros((len(v), len(low)))
                far = np.zeros((len(v), len(low)))
                for d in range(v.shape[1]):
                    x = v[:, d, None]
                    outside = np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0)
                    reach = np.maximum(np.abs(x - low[None, :, d]), np.abs(x - high[None, :, d]))
                    near += outside * outside
                    far += reach * reach
                order = np.argsort(far, axis=1, kind="stable")
                enough = np.cumsum(count[order], axis=1) >= k
                at = np.where(enough.any(axis=1), enough.argmax(axis=1), len(low) - 1)
                rows = np.arange(len(v))
                # A hair of slack keeps rounding from excluding a cell on the edge.
                bound = far[rows, order[rows, at]] * (1 + 1e-12)
                hit_row, hit_cell = np.nonzero(near <= bound[:, None])
                tests.append(part["v"].to_numpy()[hit_row])
                cells.append(cell[hit_cell])
            yield pd.DataFrame(
                {
                    "v": np.concatenate(tests) if tests else [],
                    "cell": np.concatenate(cells) if cells else [],
                }
            )

    return run


def _block_neighbors(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"v": [], "distance": [], "label": [], "w": []})
        a, b = np.vstack(left["v"]), np.vstack(right["v"])
        squared = np.zeros((len(a), len(b)))
        for d in range(a.shape[1]):
            gap = a[:, d, None] - b[None, :, d]
            squared += gap * gap
        labels = right["label"].to_numpy()
        by_label = np.argsort(labels, kind="stable")
        order = by_label[np.argsort(squared[:, by_label], axis=1, kind="stable")][:, :k]
        rows = np.repeat(np.arange(len(a)), order.shape[1])
        picked = order.reshape(-1)
        return pd.DataFrame(
            {
                "v": left["v"].to_numpy()[rows],
                "distance": squared[rows, picked],
                "label": labels[picked],
                "w": right["w"].to_numpy()[picked],
            }
        )

    return run


def knn_classify(
    train: DataFrame, test: DataFrame, features, target: str, order_by, k: int = NEIGHBORS
) -> DataFrame:
    """Majority class of the k nearest training rows: ``(keys, prediction)`` per test row.

    Equal distances prefer the smaller class, and so does an equal vote. Copies are
    collapsed into weighted points on both sides. Training points fall into a quantile
    grid of at most 4,096 cells whose boxes are broadcast; a test point visits only the
    cells that can still hold one of its neighbours, in blocks of bounded size.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    names = require_numeric(train, as_list(features))
    keys = require_order(test, order_by)
    vector = F.array(*[col(n).cast("double") for n in names])
    label_type = train.schema[target].dataType.simpleString()
    points = checkpoint(
        train.select(vector.alias("v"), col(target).alias("label"))
        .groupBy("v", "label")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    rows = points.count()
    axes, parts = _cuts(points, len(names), rows)
    grid = [(i + 1) / parts for i in range(parts - 1)]
    cell = F.lit(0).cast("long")
    placed = points
    if grid:
        cuts = points.agg(
            *[
                F.array_distinct(F.percentile_approx(F.get("v", F.lit(a)), grid, 10_000)).alias(f"c{a}")
                for a in range(axes)
            ]
        )
        placed = attach(points, cuts)
        for a in range(axes):
            cell = cell * parts + bucket_of(stat(f"c{a}"), F.get("v", F.lit(a)), parts)
    placed = checkpoint(placed.select("v", "label", "w", cell.alias("cell")))
    boxes = (
        placed.select("cell", "w", F.posexplode("v").alias("d", "x"))
        .groupBy("cell", "d")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("w").alias("n"))
        .groupBy("cell")
        .agg(
            F.sort_array(F.collect_list(F.struct("d", "low", "high"))).alias("e"), F.first("n").alias("n")
        )
        .select(
            "cell",
            "n",
            F.transform("e", lambda s: s["low"]).alias("low"),
            F.transform("e", lambda s: s["high"]).alias("high"),
        )
        .toPandas()
    )
    asked = test.select(*[col(x) for x in keys], vector.alias("v"))
    distinct = asked.select("v").distinct()
    routed = checkpoint(
        distinct.mapInPandas(_nearest_cells(boxes, k), "v array<double>, cell bigint")
    )
    found = block_join(
        routed,
        placed,
        ["cell"],
        _block_neighbors(k),
        f"v array<double>, distance double, label {label_type}, w bigint",
    )
    nearest = Window.partitionBy("v").orderBy("distance", "label")
    before = nearest.rowsBetween(Window.unboundedPreceding, -1)
    ranked = found.withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    voting = ranked.filter(F.col("before") < k).withColumn(
        "votes", F.least(F.col("w"), F.lit(k) - F.col("before"))
    )
    tally = voting.groupBy("v", "label").agg(F.sum("votes").alias("votes"))
    winners = tally.groupBy("v").agg(
        F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("prediction")
    )
    return asked.join(winners, "v").drop("v")
