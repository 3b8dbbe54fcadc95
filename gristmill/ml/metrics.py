"""Model quality measures as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gristmill.functions.types import as_list, col, is_text, require_choice, require_numeric
from gristmill.plans.blocks import block_join
from gristmill.plans.session import checkpoint
from gristmill.plans.stats import attach, stat

DIGITS = 6
NOISE = -1


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row ``(r2, mae, mse, rmse)`` from one pass."""
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    sums = df.agg(
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.var_pop(y).alias("var"),
    )
    exact = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("var") == 0, exact).otherwise(1 - F.try_divide(F.col("mse"), F.col("var")))
    return sums.select(
        F.round(r2, DIGITS).alias("r2"),
        F.round("mae", DIGITS).alias("mae"),
        F.round("mse", DIGITS).alias("mse"),
        F.round(F.sqrt("mse"), DIGITS).alias("rmse"),
    )


def classification_metrics(df: DataFrame, actual: str, predicted: str, pos_label=1) -> DataFrame:
    """One row ``(accuracy, precision, recall, f1)``.

    Two actual classes give the binary measures for ``pos_label``; otherwise each class
    is weighted by its support. A zero denominator counts as 0.
    """
    cells = (
        df.groupBy(col(actual).alias("y"), col(predicted).alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen")),
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    hits = cells.select(F.col("y").alias("label"), F.lit(0).cast("long").alias("support"),
                        F.lit(0).cast("long").alias("chosen"), hit.cast("long").alias("hits"))
    margins = cells.select(F.inline(sides)).withColumn("hits", F.lit(0).cast("long"))
    classes = margins.unionByName(hits).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hits").alias("hits")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hits") * 1.0, F.col("chosen")), zero)
    recall = F.coalesce(F.try_divide(F.col("hits") * 1.0, F.col("support")), zero)
    scored = classes.withColumn("pr", precision).withColumn("re", recall)
    f1 = F.coalesce(F.try_divide(2 * F.col("pr") * F.col("re"), F.col("pr") + F.col("re")), zero)
    scored = scored.withColumn("f", f1)
    wanted = str(pos_label) if is_text(df.schema[actual]) else pos_label
    positive = F.col("label") == F.lit(wanted)

    def mean(c):
        return F.sum(F.col(c) * F.col("support")) / F.sum("support")

    def binary(c):
        return F.coalesce(F.max(F.when(positive, F.col(c))), zero)

    summary = scored.agg(
        F.count_if(F.col("support") > 0).alias("classes"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        *[mean(c).alias(f"w{c}") for c in ("pr", "re", "f")],
        *[binary(c).alias(f"b{c}") for c in ("pr", "re", "f")],
    )

    def chosen(c):
        return F.round(F.when(F.col("classes") == 2, F.col(f"b{c}")).otherwise(F.col(f"w{c}")), DIGITS)

    return summary.select(
        F.round("accuracy", DIGITS).alias("accuracy"),
        chosen("pr").alias("precision"),
        chosen("re").alias("recall"),
        chosen("f").alias("f1"),
    )


def _distance_sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Weighted sums of distances from each left point to each cluster of the right block."""
    if left.empty or right.empty:
        return pd.DataFrame({"v": [], "own": [], "label": [], "total": []})
    a, b = np.vstack(left["v"]), np.vstack(right["v"])
    labels, place = np.unique(right["label"].to_numpy(), return_inverse=True)
    squared = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        gap = a[:, k, None] - b[None, :, k]
        squared += gap * gap
    weights = np.zeros((len(b), len(labels)))
    weights[np.arange(len(b)), place.reshape(-1)] = right["w"].to_numpy(dtype=float)
    totals = np.sqrt(squared) @ weights
    return pd.DataFrame(
        {
            "v": np.repeat(left["v"].to_numpy(), len(labels)),
            "own": np.repeat(left["own"].to_numpy(), len(labels)),
            "label": np.tile(labels, len(a)),
            "total": totals.reshape(-1),
        }
    )


def silhouette(df: DataFrame, features, label: str, method: str = "euclidean") -> DataFrame:
    """One row ``(n_clusters, silhouette)``; noise (-1) is no cluster but takes part.

    ``euclidean`` is exact and needs all distances: quadratic work, done in blocks that
    return one sum per point and cluster. ``squared`` uses squared distances, which
    expand into cluster sums: one linear pass, the choice for very large tables.
    """
    require_choice(method, ("euclidean", "squared"), "method")
    names = require_numeric(df, as_list(features))
    vector = F.array(*[col(n).cast("double") for n in names])
    points = (
        df.select(vector.alias("v"), col(label).cast("long").alias("label"))
        .groupBy("v", "label")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    clusters = points.groupBy("label").agg(F.sum("w").alias("size"))
    if method == "euclidean":
        own = points.withColumnRenamed("label", "own")
        partial = block_join(
            own.select("v", "own"),
            points,
            [],
            _distance_sums,
            "v array<double>, own bigint, label bigint, total double",
        )
        sums = partial.groupBy("v", "own", "label").agg(F.sum("total").alias("total"))
        sized = sums.join(own, ["v", "own"]).join(clusters, "label")
        mine = F.col("label") == F.col("own")
        mean = F.try_divide(F.col("total"), F.col("size") - F.when(mine, 1).otherwise(0))
        scored = sized.withColumn("mean", mean).groupBy("v", "own", "w").agg(
            F.max(F.when(mine, F.col("mean"))).alias("a"),
            F.min(F.when(~mine, F.col("mean"))).alias("b"),
        )
    else:
        scored = _squared_means(points)
    s = F.coalesce(
        F.try_divide(F.col("b") - F.col("a"), F.nullif(F.greatest("a", "b"), F.lit(0.0))), F.lit(0.0)
    )
    s = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(s)
    mean_s = scored.agg(F.try_divide(F.sum(s * F.col("w")), F.sum("w")).alias("s"))
    counts = clusters.agg(
        F.count(F.lit(1)).alias("labels"), F.count_if(F.col("label") != NOISE).alias("n_clusters")
    )
    return attach(counts, mean_s).select(
        "n_clusters",
        F.when(F.col("labels") > 1, F.round(stat("s"), DIGITS)).alias("silhouette"),
    )


def _nearest_means(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Mean squared distance of each point to its own cluster and to the nearest other one.

    ``right`` is a block of clusters with their size, sum of squares and sum of vectors.
    """
    if left.empty or right.empty:
        return pd.DataFrame({"v": [], "own": [], "w": [], "a": [], "b": []})
    x, s = np.vstack(left["v"]), np.vstack(right["s"])
    n, q = right["n"].to_numpy(dtype=float), right["q"].to_numpy(dtype=float)
    total = np.maximum((x * x).sum(axis=1)[:, None] * n[None, :] - 2 * x @ s.T + q[None, :], 0.0)
    mine = left["own"].to_numpy()[:, None] == right["label"].to_numpy()[None, :]
    rest = n[None, :] - mine
    mean = np.divide(total, rest, out=np.full(total.shape, np.nan), where=rest > 0)
    own = np.where(mine, mean, np.nan)
    other = np.where(mine, np.inf, mean).min(axis=1)
    has = ~np.isnan(own).all(axis=1)
    a = np.where(has, np.nanmax(np.where(has[:, None], own, 0.0), axis=1), np.nan)
    return pd.DataFrame({
        "v": left["v"].to_numpy(), "own": left["own"].to_numpy(), "w": left["w"].to_numpy(),
        "a": pd.Series(a, dtype=object).where(has, None), "b": pd.Series(other, dtype=object).where(np.isfinite(other), None),
    })


def _squared_means(points: DataFrame) -> DataFrame:
    """``(v, own, w, a, b)`` from cluster moments, in blocks of points and clusters."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    moments = points.withColumn("q", norm).groupBy("label").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("q")).alias("q")
    )
    axes = (
        points.select("label", "w", F.posexplode("v").alias("d", "x"))
        .groupBy("label", "d")
        .agg(F.sum(F.col("w") * F.col("x")).alias("s"))
        .groupBy("label")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda e: e["s"]).alias("s"))
    )
    clusters = checkpoint(moments.join(axes, "label"))
    own = checkpoint(points.withColumnRenamed("label", "own"))
    partial = block_join(
        own, clusters, [], _nearest_means, "v array<double>, own bigint, w bigint, a double, b double"
    )
    return partial.groupBy("v", "own", "w").agg(F.max("a").alias("a"), F.min("b").alias("b"))
