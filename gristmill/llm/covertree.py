"""Exact threshold pairs of embeddings by cover trees and dual traversal.

Vectors are compared inside one label, as points on the unit sphere. Equal vectors are one point
with a weight. A cover tree has nested levels with halving radii: the centres of a level are
further apart than its radius, every point lies within the radius of its centre, and a centre
stays one below. Two trees are walked together, level by level: a pair of nodes is dropped when
their centres are further apart than the threshold and both covering radii, taken as a whole
when even the furthest points are near enough, and else replaced by the pairs of their children.
What is left at the end is decided by the cosine in double precision.

The upper levels are spread over the cluster: a label gets centres in proportion to its size (a
bounded number in all, chosen by hash), every point goes to its nearest one, and pairs of cells
are dropped by the same bound. A cell is dealt into blocks of bounded size; one task builds one
block's tree once, another walks one pair of blocks. Tasks return a count of links per point and a
spanning forest, never the pairs themselves, so a dense group costs its points, not its square, in
rows. The work is quadratic only where the bounds cannot separate, as between blocks of points in
high dimension that have no structure.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
vectors without label or id, link with nothing; vectors of different length do not link;
repeated rows of one id are one vector; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gristmill.llm.tables import components, forest, in_batches, small
from gristmill.plans.session import checkpoint

BLOCK = 2048
CENTRES = 2_000
RADII = [2.0 ** -k for k in range(0, 8)]
CHUNK = 1 << 15


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def build(points: np.ndarray) -> np.ndarray:
    """Cover tree of unit vectors: the centre of each point at each level ``[points, levels]``."""
    n = len(points)
    path = np.zeros((n, len(RADII)), dtype=np.int32)
    nodes = [np.arange(n)]
    for level, radius in enumerate(RADII):
        most = 1 - radius * radius / 2  # the cosine at that distance
        below = []
        for node in nodes:
            rest = node
            while len(rest):
                if len(rest) == 1:
                    near = np.array([True])
                else:
                    near = points[rest] @ points[rest[0]] >= most
                    near[0] = True
                path[rest[near], level] = rest[0]
                below.append(rest[near])
                rest = rest[~near]
        nodes = below
    return path


class Level:
    """Nodes of one level: centres, covering radii, members in a row and children."""

    def __init__(self, points: np.ndarray, group: np.ndarray, parent: np.ndarray | None):
        self.order = np.argsort(group, kind="stable")
        owner = group[self.order]
        self.first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        self.last = np.r_[self.first[1:], len(owner)]
        self.centre = owner[self.first]
        self.node = np.empty(len(group), dtype=np.int64)
        self.node[self.order] = np.repeat(np.arange(len(self.first)), self.last - self.first)
        away = np.sqrt(np.maximum(0, ((points - points[group]) ** 2).sum(axis=1)))
        self.radius = np.maximum.reduceat(away[self.order], self.first)
        self.parent = None if parent is None else parent[self.centre]

    @property
    def size(self) -> np.ndarray:
        return self.last - self.first


class Tree:
    def __init__(self, vectors: np.ndarray, path: np.ndarray):
        self.vectors, self.points = vectors, unit(vectors)
        self.length = np.sqrt((vectors * vectors).sum(axis=1))
        self.levels: list[Level] = []
        for k in range(path.shape[1]):
            self.levels.append(Level(self.points, path[:, k], self.levels[-1].node if k else None))
        # Below the last level every point is a node of its own.
        self.levels.append(Level(self.points, np.arange(len(vectors)), self.levels[-1].node))
        self.children = []
        for upper, lower in zip(self.levels, self.levels[1:]):
            order = np.argsort(lower.parent, kind="stable")
            first = np.searchsorted(lower.parent[order], np.arange(len(upper.first) + 1))
            self.children.append((order, first))


def expand(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups ``which`` of a list of groups: (place in ``which``, place in the list)."""
    n = first[which + 1] - first[which]
    owner = np.repeat(np.arange(len(which)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[which], n)


def pairs_of(left: Tree, right: Tree, level: int, a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of children of the node pairs ``(a, b)`` of a level, in bounded chunks."""
    kids_a, first_a = left.children[level]
    kids_b, first_b = right.children[level]
    weight = (first_a[a + 1] - first_a[a]) * (first_b[b + 1] - first_b[b])
    cut = np.flatnonzero(np.diff(np.cumsum(weight) // CHUNK, prepend=0)) if len(a) else []
    for part in np.split(np.arange(len(a)), cut):
        if not len(part):
            continue
        owner, x = expand(first_a, a[part])
        again, y = expand(first_b, b[part][owner])
        x, y, owner = kids_a[x[again]], kids_b[y], owner[again]
        if same:
            twin = a[part][owner] == b[part][owner]
            good = ~twin | (x <= y)
            x, y = x[good], y[good]
        yield x, y


def walk(left: Tree, right: Tree, weights: tuple[np.ndarray, np.ndarray], cosine: float, same: bool):
    """Links of two trees (or one with itself): counts on either side, and linked pairs.

    The linked pairs connect all that is linked, but need not hold every link.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    count_l, count_r = np.zeros(len(left.points)), np.zeros(len(right.points))
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decide node pairs of a level; returns those to be opened."""
        up, down = left.levels[level], right.levels[level]
        ca, cb = up.centre[x], down.centre[y]
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", left.points[ca], right.points[cb])))
        spread = up.radius[x] + down.radius[y]
        near = gap - spread <= reach + 1e-7
        x, y, gap, spread = x[near], y[near], gap[near], spread[near]
        one = (up.size[x] == 1) & (down.size[y] == 1)
        i, j = up.centre[x[one]], down.centre[y[one]]
        if same:
            i, j = i[i != j], j[i != j]
        value = np.einsum("ij,ij->i", left.vectors[i], right.vectors[j]) / (left.length[i] * right.length[j])
        link(i[value >= cosine], j[value >= cosine])
        x, y, gap, spread = x[~one], y[~one], gap[~one], spread[~one]
        sure = gap + spread <= reach - 1e-7
        for m, n in zip(x[sure], y[sure]):
            whole(up.order[up.first[m] : up.last[m]], down.order[down.first[n] : down.last[n]], same and m == n)
        return x[~sure], y[~sure]

    def link(i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(count_l, i, weights[1][j])
        np.add.at(count_r, j, weights[0][i])
        edges.append((i, j))

    def whole(i: np.ndarray, j: np.ndarray, twin: bool) -> None:
        """All points of two nodes are linked."""
        if twin:
            count_l[i] += weights[0][i].sum() - weights[0][i]
            edges.append((i[:1].repeat(len(i)), i))
        else:
            count_l[i] += weights[1][j].sum()
            count_r[j] += weights[0][i].sum()
            edges.append((i, j[:1].repeat(len(i))))
            edges.append((i[:1].repeat(len(j)), j))

    def first() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes of the first level, by rows of a matrix product."""
        up, down = left.levels[0], right.levels[0]
        step = max(1, CHUNK // max(1, len(down.first)))
        for low in range(0, len(up.first), step):
            gap = np.sqrt(np.maximum(0, 2 - 2 * (left.points[up.centre[low : low + step]] @ right.points[down.centre].T)))
            i, j = np.nonzero(gap - up.radius[low : low + step, None] - down.radius[None, :] <= reach + 1e-7)
            good = i + low <= j if same else slice(None)
            yield i[good] + low, j[good]

    opened = [settle(0, x, y) for x, y in first()]
    for level in range(len(left.levels) - 1):
        if not opened:
            break
        x, y = (np.concatenate(z) for z in zip(*opened))
        opened = [settle(level + 1, *pair) for pair in pairs_of(left, right, level, x, y, same)]
    return count_l, count_r, edges


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of the vectors that can link, repeated rows once."""
    vector = F.col("embedding").cast("array<double>")
    fine = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
        & F.exists(vector, lambda x: x != 0)
    )
    rows = embeddings.select("vec_id", "label", "embedding").where(F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", "label", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"))


def linked(points: DataFrame, cosine: float, block: int = BLOCK, centres: int = CENTRES) -> tuple[DataFrame, DataFrame]:
    """Counts ``(rep, links)`` and connecting pairs ``(a, b)`` of ``points(rep, label, vector, weight)``."""
    spark = points.sparkSession
    points = points.withColumn("kind", F.struct("label", F.size("vector").alias("dim")))
    sizes = {(r.kind.label, r.kind.dim): r["count"] for r in points.groupBy("kind").count().where(F.col("count") > block).orderBy(F.desc("count")).limit(centres).collect()}
    wanted = {k: math.ceil(n / block) for k, n in sizes.items()}
    scale = min(1.0, centres / max(1, sum(wanted.values())))
    chosen = {}
    if wanted:
        share = spark.createDataFrame([(k[0], k[1], float(scale * wanted[k] / sizes[k])) for k in wanted], f"l {points.schema['label'].dataType.simpleString()}, d int, share double")
        drawn = F.pmod(F.xxhash64("rep", F.lit(99)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        picked = points.join(F.broadcast(share), (F.col("label") == F.col("l")) & (F.col("kind.dim") == F.col("d"))).where(drawn < F.col("share"))
        for r in picked.orderBy("rep").limit(2 * centres).collect():
            chosen.setdefault((r.kind.label, r.kind.dim), []).append(r.vector)
    chosen = {k: unit(np.array(v)) for k, v in chosen.items()}
    shared = spark.sparkContext.broadcast(chosen)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            cell, away = np.zeros(batch.num_rows, dtype=np.int32), np.full(batch.num_rows, 2.0)
            groups: dict = {}
            for i, k in enumerate(kinds):
                groups.setdefault((k["label"], k["dim"]), []).append(i)
            for key, rows in groups.items():
                if key in shared.value:
                    cosines = unit(matrix(batch.column("vector").take(pa.array(rows)))) @ shared.value[key].T
                    cell[rows] = cosines.argmax(axis=1)
                    away[rows] = np.sqrt(np.maximum(0, 2 - 2 * cosines.max(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    placed = checkpoint(in_batches(points, place, f"{schema}, cell int, away double"))
    cells = checkpoint(placed.groupBy("kind", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")))
    part = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")
    dealt = placed.join(small(cells.select("kind", "cell", "blocks")), ["kind", "cell"]).withColumn("part", part)

    def plant(table: pa.Table) -> pa.Table:
        # Centres are named by their place in the order of ids, which later readers restore.
        table = table.take(pa.array(np.argsort(table.column("rep").to_numpy())))
        path = build(unit(matrix(table.column("vector"))))
        flat = pa.array(path.reshape(-1))
        offsets = pa.array(np.arange(len(path) + 1, dtype=np.int32) * path.shape[1])
        return table.append_column("path", pa.ListArray.from_arrays(offsets, flat))

    columns = ["kind", "cell", "part", "rep", "vector", "weight"]
    dealt = dealt.select(*columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    trees = checkpoint(dealt.groupBy("kind", "cell", "part").applyInArrow(plant, f"{schema}, path array<int>"))
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    near = []
    for r in cells.where(F.col("kind.label").isNotNull()).groupBy("kind").agg(F.collect_list(F.struct("cell", "radius", "blocks")).alias("c")).where(F.size("c") > 1).limit(centres).collect():
        middle = chosen[(r.kind.label, r.kind.dim)]
        listed = sorted(r.c)
        for m, x in enumerate(listed):
            for y in listed[m + 1 :]:
                if np.linalg.norm(middle[x.cell] - middle[y.cell]) - x.radius - y.radius <= reach + 1e-7:
                    near.append((r.kind.label, r.kind.dim, x.cell, y.cell))
    label = points.schema["label"].dataType.simpleString()
    apart = spark.createDataFrame(near, f"l {label}, d int, c1 int, c2 int").select(F.struct(F.col("l").alias("label"), F.col("d").alias("dim")).alias("kind"), "c1", "c2")
    inside = cells.select("kind", F.col("cell").alias("c1"), F.col("cell").alias("c2"))
    parts = cells.select("kind", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    one, two = parts.select("kind", F.col("cell").alias("c1"), F.col("part").alias("p1")), parts.select("kind", F.col("cell").alias("c2"), F.col("part").alias("p2"))
    duels = checkpoint(
        apart.unionByName(inside).join(one, ["kind", "c1"]).join(two, ["kind", "c2"])
        .where("c1 <> c2 OR p1 <= p2").select("kind", "c1", "p1", "c2", "p2")
    )
    duel = ["kind", "c1", "p1", "c2", "p2"]
    sides = duels.select(*duel, F.col("c1").alias("cell"), F.col("p1").alias("part"), F.lit(0).alias("side")).union(
        duels.where("c1 <> c2 OR p1 <> p2").select(*duel, "c2", "p2", F.lit(1))
    )
    met = trees.join(sides, ["kind", "cell", "part"]).select(*duel, "side", "rep", "vector", "weight", "path")

    def fight(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        order = np.lexsort((table.column("rep").to_numpy(), side))
        halves = []
        for rows in (order[side[order] == 0], order[side[order] == 1]):
            if len(rows):
                held = table.take(pa.array(rows))
                tree = Tree(matrix(held.column("vector")), matrix(held.column("path")).astype(np.int64))
                halves.append((held.column("rep").to_numpy(), held.column("weight").to_numpy().astype(float), tree))
        same = len(halves) == 1
        (ra, wa, ta), (rb, wb, tb) = halves[0], halves[-1]
        ca, cb, edges = walk(ta, tb, (wa, wb), cosine, same)
        if same:
            reps, links = ra, ca + cb
        else:
            reps, links = np.r_[ra, rb], np.r_[ca, cb]
            edges = [(i, j + len(ra)) for i, j in edges]
        root = reps[forest(len(reps), edges)]
        keep = links > 0
        return pa.table({"rep": reps[keep], "links": links[keep].astype(np.int64), "root": root[keep]})

    found = checkpoint(met.groupBy(*duel).applyInArrow(fight, "rep long, links long, root long"))
    return found.groupBy("rep").agg(F.sum("links").alias("links")), found.select(F.col("rep").alias("a"), F.col("root").alias("b"))


def near_vectors(embeddings: DataFrame, cosine: float = 0.93, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    rows = checkpoint(usable(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")))
    points = checkpoint(
        rows.distinct().groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    )
    links, pairs = linked(points.select("rep", "label", "vector", "weight"), cosine, block, centres)
    roots = components(pairs)
    classes = (
        points.join(links, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "vector", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    members = rows.join(classes, ["label", "vector"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    return every.join(members, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
