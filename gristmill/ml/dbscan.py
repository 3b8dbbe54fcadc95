"""Exact density-based clustering.

Copies collapse into weighted points. Points fall into cells whose diagonal is at most
``eps``: everything inside a cell is mutually near, so a cell of ``min_samples`` rows is
all core and connected without comparing its points. Points are compared only where a
cell is sparse, or where two neighbouring cells might or might not touch, always in
blocks of bounded size that return reduced results. Cells, not points, are then joined
into components.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gristmill.functions.types import as_list, col, require_numeric, require_order
from gristmill.plans.blocks import block_join
from gristmill.plans.ordering import key_struct, with_row_number
from gristmill.plans.session import checkpoint

EPS, MIN_SAMPLES = 0.5, 5
NEIGHBOR_AXES = 3
SMALL_PAIR = 50_000
SLACK = 1e-9
NOISE = -1


def _squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d, None] - b[None, :, d]
        out += gap * gap
    return out


def _cell(v: str, side: float) -> Column:
    return F.transform(v, lambda x: F.floor(x / F.lit(side)))


def _coarse(v: Column, side: float, axes: int) -> Column:
    return F.transform(F.slice(v, 1, axes), lambda x: F.floor(x / F.lit(side)))


def _around(coarse: Column, axes: int) -> Column:
    """The coarse cell and its neighbours: 3 ** axes cells, at most 27."""
    steps = [[]]
    for _ in range(axes):
        steps = [[*s, move] for s in steps for move in (-1, 0, 1)]
    return F.array(
        *[F.array(*[F.get(coarse, F.lit(d)) + move for d, move in enumerate(s)]) for s in steps]
    )


def _count_near(eps: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"v": [], "near": []})
        near = _squared_distances(np.vstack(left["v"]), np.vstack(right["v"])) <= eps * eps
        return pd.DataFrame({"v": left["v"], "near": (near @ right["w"].to_numpy()).astype(np.int64)})

    return run


def core_points(df: DataFrame, features, eps: float = EPS, min_samples: int = MIN_SAMPLES, order_by=None):
    """Distinct points ``(v, w, first, cell, coarse, core)`` with their core flag."""
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps must be positive and min_samples at least 1")
    names = require_numeric(df, as_list(features))
    keys = require_order(df, order_by)
    axes = min(len(names), NEIGHBOR_AXES)
    side = eps / math.sqrt(len(names)) * (1 - SLACK)
    wide = eps * (1 + SLACK)
    # Adding zero turns -0.0 into 0.0, so that equal points group together.
    vector = F.array(*[col(n).cast("double") + F.lit(0.0) for n in names])
    points = checkpoint(
        df.na.drop("any", subset=names)
        .groupBy(vector.alias("v"))
        .agg(F.count(F.lit(1)).alias("w"), F.min(key_struct(keys)).alias("first"))
        .withColumn("cell", _cell("v", side))
        .withColumn("coarse", _coarse(F.col("v"), wide, axes))
    )
    dense = points.groupBy("cell").agg(F.sum("w").alias("cell_rows"))
    sized = points.join(dense, "cell")
    sparse = sized.filter(F.col("cell_rows") < min_samples)
    asking = sparse.select("v", F.explode(_around(F.col("coarse"), axes)).alias("coarse"))
    counted = block_join(
        asking, points.select("coarse", "v", "w"), ["coarse"], _count_near(eps), "v array<double>, near bigint"
    )
    enough = (
        counted.groupBy("v").agg(F.sum("near").alias("near")).filter(F.col("near") >= min_samples)
    ).select("v", F.lit(True).alias("near_core"))
    flagged = sized.join(enough, "v", "left")
    core = (F.col("cell_rows") >= min_samples) | F.coalesce("near_core", F.lit(False))
    return checkpoint(flagged.select("v", "w", "first", "cell", "coarse", core.alias("core")))


def _box(points: DataFrame, groups) -> DataFrame:
    """Bounding box and number of distinct points of each group."""
    axes = (
        points.select(*groups, F.posexplode("v").alias("d", "x"))
        .groupBy(*groups, "d")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))
    )
    return axes.groupBy(*groups).agg(
        F.sort_array(F.collect_list(F.struct("d", "low", "high"))).alias("box"), F.first("n").alias("n")
    )


def _box_gap(a: Column, b: Column) -> Column:
    """Squared distance of two boxes at their nearest."""
    gaps = F.zip_with(
        a, b, lambda p, q: F.greatest(p["low"] - q["high"], q["low"] - p["high"], F.lit(0.0))
    )
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def _box_reach(a: Column, b: Column) -> Column:
    """Squared distance of two boxes at their farthest."""
    spans = F.zip_with(a, b, lambda p, q: F.greatest(p["high"] - q["low"], q["high"] - p["low"]))
    return F.aggregate(spans, F.lit(0.0), lambda s, g: s + g * g)


def _near_boxes(eps: float):
    """Pairs of cells whose boxes come within eps, with both verdicts."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "sure": []})
        if left.empty or right.empty:
            return empty
        al, ah, bl, bh = (np.vstack(f[c]) for f in (left, right) for c in ("low", "high"))
        ai, bi = left["id"].to_numpy(), right["id"].to_numpy()
        gap = np.zeros((len(al), len(bl)))
        reach = np.zeros_like(gap)
        for d in range(al.shape[1]):
            over = np.maximum(al[:, d, None] - bh[None, :, d], bl[None, :, d] - ah[:, d, None])
            span = np.maximum(ah[:, d, None] - bl[None, :, d], bh[None, :, d] - al[:, d, None])
            gap += np.maximum(over, 0) ** 2
            reach += span * span
        i, j = np.nonzero((gap <= eps * eps * (1 + SLACK)) & (ai[:, None] < bi[None, :]))
        return pd.DataFrame(
            {"a": ai[i], "b": bi[j], "sure": reach[i, j] <= eps * eps * (1 - SLACK)}
        )

    return run


def _touching(eps: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []})
        a, b = np.vstack(left["v"]), np.vstack(right["v"])
        step = max(1, 4_000_000 // len(b))
        for start in range(0, len(a), step):
            if (_squared_distances(a[start : start + step], b) <= eps * eps).any():
                return pd.DataFrame({"a": [left["a"].iloc[0]], "b": [left["b"].iloc[0]]})
        return pd.DataFrame({"a": [], "b": []})

    return run


def _cell_edges(core: DataFrame, nodes: DataFrame, eps: float, axes: int) -> DataFrame:
    """Pairs ``(a, b)`` of core cells that hold two points within eps of each other."""
    coarse = _coarse(F.transform("box", lambda e: e["low"]), 2 * eps, axes)
    boxes = nodes.select(
        "id",
        F.transform("box", lambda e: e["low"]).alias("low"),
        F.transform("box", lambda e: e["high"]).alias("high"),
        coarse.alias("coarse"),
    )
    asking = boxes.withColumn("coarse", F.explode(_around(F.col("coarse"), axes)))
    near = checkpoint(
        block_join(asking, boxes, ["coarse"], _near_boxes(eps), "a bigint, b bigint, sure boolean").distinct()
    )
    edges = near.filter("sure").select("a", "b")
    parts = core.select("id", "v", F.lit("").alias("part"))
    sizes = nodes.select("id", F.lit("").alias("part"), "n")
    open_pairs = near.filter(~F.col("sure")).select(
        "a", "b", F.lit("").alias("pa"), F.lit("").alias("pb")
    )
    level = 0
    while True:
        sa = sizes.select(F.col("id").alias("a"), F.col("part").alias("pa"), F.col("n").alias("na"))
        sb = sizes.select(F.col("id").alias("b"), F.col("part").alias("pb"), F.col("n").alias("nb"))
        open_pairs = checkpoint(open_pairs.join(sa, ["a", "pa"]).join(sb, ["b", "pb"]))
        small = open_pairs.filter(F.col("na") + F.col("nb") <= SMALL_PAIR)
        pa = parts.select(F.col("id").alias("a"), F.col("part").alias("pa"), "v")
        pb = parts.select(F.col("id").alias("b"), F.col("part").alias("pb"), "v")
        keys = ["a", "b", "pa", "pb"]
        touching = block_join(
            small.select(*keys).join(pa, ["a", "pa"]),
            small.select(*keys).join(pb, ["b", "pb"]),
            keys,
            _touching(eps),
            "a bigint, b bigint",
        )
        edges = checkpoint(edges.unionByName(touching).distinct())
        large = open_pairs.filter(F.col("na") + F.col("nb") > SMALL_PAIR).join(
            edges, ["a", "b"], "left_anti"
        )
        if large.isEmpty():
            return edges
        # Halve the boxes of the crowded pairs that are still undecided.
        level += 1
        crowded = large.select(F.col("a").alias("id"), F.col("pa").alias("part")).unionByName(
            large.select(F.col("b").alias("id"), F.col("pb").alias("part"))
        ).distinct()
        inside = parts.join(crowded, ["id", "part"])
        centres = _box(inside, ["id", "part"]).select(
            "id", "part", F.transform("box", lambda e: (e["low"] + e["high"]) / 2).alias("mid")
        )
        digits = F.array_join(
            F.zip_with("v", "mid", lambda x, m: F.when(x > m, "1").otherwise("0")), ""
        )
        parts = checkpoint(
            inside.join(centres, ["id", "part"]).select(
                "id", "v", F.concat("part", F.lit("/"), digits).alias("part"), F.col("part").alias("parent")
            )
        )
        child = _box(parts, ["id", "part", "parent"])
        sizes = child.select("id", "part", "n")
        ca = child.select(
            F.col("id").alias("a"), F.col("parent").alias("pa"), F.col("part").alias("ka"), F.col("box").alias("ba")
        )
        cb = child.select(
            F.col("id").alias("b"), F.col("parent").alias("pb"), F.col("part").alias("kb"), F.col("box").alias("bb")
        )
        # Each undecided pair meets the children of its two boxes only.
        met = large.select("a", "b", "pa", "pb").join(ca, ["a", "pa"]).join(cb, ["b", "pb"])
        judged = checkpoint(
            met.withColumn("gap", _box_gap(F.col("ba"), F.col("bb")))
            .filter(F.col("gap") <= eps * eps * (1 + SLACK))
            .withColumn("sure", _box_reach(F.col("ba"), F.col("bb")) <= eps * eps * (1 - SLACK))
            .select("a", "b", F.col("ka").alias("pa"), F.col("kb").alias("pb"), "sure")
        )
        edges = checkpoint(edges.unionByName(judged.filter("sure").select("a", "b")).distinct())
        open_pairs = judged.filter(~F.col("sure")).drop("sure").join(edges, ["a", "b"], "left_anti")
        parts = parts.drop("parent")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` with the smallest id of the component.

    In each round every component adopts the smallest label next to any of its members,
    and the chains of adoptions are shortened by jumping, so components merge in a
    logarithmic number of rounds. Every round is written to the shared folder.
    """
    both = checkpoint(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    labels = checkpoint(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("low")), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("low").alias("low"))
        )
        adopted = checkpoint(
            labels.join(near, "id", "left")
            .groupBy("component")
            .agg(F.min("low").alias("low"))
            .select("component", F.least("component", F.coalesce("low", "component")).alias("to"))
        )
        if adopted.filter(F.col("to") != F.col("component")).isEmpty():
            return labels
        for _ in range(2):
            onward = adopted.select(F.col("component").alias("to"), F.col("to").alias("next"))
            adopted = checkpoint(
                adopted.join(onward, "to").select("component", F.col("next").alias("to"))
            )
        labels = checkpoint(
            labels.join(adopted, "component").select("id", F.col("to").alias("component"))
        )


def _lowest_label(eps: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"v": [], "label": []})
        near = _squared_distances(np.vstack(left["v"]), np.vstack(right["v"])) <= eps * eps
        far = np.iinfo(np.int64).max
        low = np.where(near, right["label"].to_numpy()[None, :], far).min(axis=1)
        hit = low < far
        return pd.DataFrame({"v": left["v"].to_numpy()[hit], "label": low[hit]})

    return run


def dbscan(
    df: DataFrame, features, order_by, eps: float = EPS, min_samples: int = MIN_SAMPLES
) -> DataFrame:
    """``(keys, cluster, core)`` per complete row; clusters count up by first core row.

    A border point takes the lowest label among the core points it is near to; noise is -1.
    """
    names = require_numeric(df, as_list(features))
    keys = require_order(df, order_by)
    axes = min(len(names), NEIGHBOR_AXES)
    points = core_points(df, names, eps, min_samples, keys)
    core = points.filter("core")
    firsts = core.groupBy("cell").agg(F.min("first").alias("first"))
    numbered = with_row_number(firsts, ["first"], "id").select("cell", "id")
    boxed = _box(core, ["cell"]).join(numbered, "cell")
    nodes = checkpoint(boxed)
    located = checkpoint(core.join(nodes.select("cell", "id"), "cell").select("v", "coarse", "id"))
    edges = _cell_edges(located, nodes, eps, axes)
    components = connected_components(nodes, edges)
    # Node ids follow the first core row, so the smallest id orders the clusters.
    order = with_row_number(components.select("component").distinct(), ["component"], "label")
    labelled = checkpoint(
        located.join(components, "id").join(order, "component").select("v", "coarse", "label")
    )
    border = points.filter(~F.col("core")).select(
        "v", F.explode(_around(F.col("coarse"), axes)).alias("coarse")
    )
    reached = (
        block_join(border, labelled, ["coarse"], _lowest_label(eps), "v array<double>, label bigint")
        .groupBy("v")
        .agg(F.min("label").alias("label"))
    )
    found = labelled.select("v", "label", F.lit(True).alias("core")).unionByName(
        reached.select("v", "label", F.lit(False).alias("core"))
    )
    vector = F.array(*[col(n).cast("double") + F.lit(0.0) for n in names])
    rows = df.na.drop("any", subset=names).select(*[col(k) for k in keys], vector.alias("v"))
    return rows.join(found, "v", "left").select(
        *[col(k) for k in keys],
        F.coalesce("label", F.lit(NOISE).cast("long")).alias("cluster"),
        F.coalesce("core", F.lit(False)).alias("core"),
    )


def core_flags(
    df: DataFrame, features, order_by, eps: float = EPS, min_samples: int = MIN_SAMPLES
) -> DataFrame:
    """``(keys, core)`` per complete row."""
    names = require_numeric(df, as_list(features))
    keys = require_order(df, order_by)
    points = core_points(df, names, eps, min_samples, keys).select("v", "core")
    vector = F.array(*[col(n).cast("double") + F.lit(0.0) for n in names])
    rows = df.na.drop("any", subset=names).select(*[col(k) for k in keys], vector.alias("v"))
    return rows.join(points, "v").select(*[col(k) for k in keys], "core")
