"""Near-duplicate documents by DartMinHash signatures, banded joins and exact verification.

A document is the multiset of its five-word runs. Every (run, unit of weight, unit of rank) is a
region of area one into which a Poisson number of darts is thrown; number, rank and coordinate
of the darts come from a hash of the region, so equal regions of two documents get equal darts.
The earliest dart of each coordinate makes the signature, and two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. One pass over the runs
serves all coordinates. Few runs are compensated by throwing up to a later rank.

Documents with the same multiset of runs are one class before anything is compared, so copies
cost nothing later. Classes that share a band are candidates, and every link is verified on the
multisets themselves (on 32-bit hashes of runs: for texts of a million runs this may overstate
a similarity by 0.0002).

Large bands are never expanded into all pairs. Their members are compared with the smallest one;
then links are contracted to components. Where a large band still holds several of them, what such bands hold together is compared in full, in
pairs of blocks inside tasks that return spanning forests.

Defined cases: a text of one to four words is one run; null texts and texts without words are
similar to nothing; rows with a null id stay alone; repeated rows belong to one class; different
texts under one id are documents of their own, each in the class of its text, and of a class one
text stays, from the smallest id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gristmill.llm.tables import components, forest, free_name, in_batches, small
from gristmill.llm.words import ORDER, longs, mix, runs, slices, words_of
from gristmill.plans.session import checkpoint

RUN = 5
BANDS, ROWS = 25, 4
GROUP = 24
BLOCK, BLOCK_RUNS, COLUMNS = 512, 1_000_000, 4096
SLICE, SLICE_ROWS = 1 << 20, 400  # a short text takes as many darts as one of a thousand runs
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(14)])
UNIT, RANK, DART = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words, length: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, run, times) of a slice, ordered by text and run."""
    hashes, owner = words.hashes(), words.owner()
    found, at = runs(words, hashes, length)
    text = owner[at]
    for short in range(1, length):  # a text too short for a run is one run as a whole
        if (words.counts == short).any():
            one, where = runs(words, hashes, short)
            chosen = words.counts[owner[where]] == short
            found, text = np.r_[found, one[chosen]], np.r_[text, owner[where][chosen]]
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    if not len(found):
        return text, found, text
    first = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (text[1:] != text[:-1])])
    return text[first], found[first], np.diff(np.r_[first, len(found)])


def throw(owner, key, weight, texts: int, k: int) -> np.ndarray:
    """Signatures ``[texts, k]``; texts without elements keep EMPTY.

    Weights may be fractions: the last unit of a weight accepts only darts below its end.
    """
    signature = np.full(texts * k, EMPTY, dtype=np.uint64)
    total = np.bincount(owner, weights=weight, minlength=texts)
    depth = np.ceil(k * (math.log(k) + 6) / np.maximum(total, 1e-9)).astype(np.int64)
    open_texts = total > 0
    while open_texts.any():
        chosen = np.flatnonzero(open_texts[owner])
        text, units = owner[chosen], np.ceil(weight[chosen]).astype(np.int64)
        cells = units * depth[text]
        element = np.repeat(np.arange(len(chosen)), cells)
        inside = np.arange(len(element)) - np.repeat(np.cumsum(cells) - cells, cells)
        unit, rank = np.divmod(inside, depth[text][element])
        region = mix(key[chosen][element] + unit.astype(np.uint64) * UNIT + rank.astype(np.uint64) * RANK)
        darts = np.searchsorted(POISSON, (region >> np.uint64(32)).astype(np.float64) / 2.0**32, side="right")
        cell = np.repeat(np.arange(len(region)), darts)
        number = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(region[cell] + (number + 1).astype(np.uint64) * DART)
        if (weight != np.floor(weight)).any():
            height = unit[cell] + (mix(dart, 3) >> np.uint64(11)).astype(np.float64) / 2.0**53
            good = height < weight[chosen][element[cell]]
            cell, dart = cell[good], dart[good]
        place = text[element[cell]] * k + ((dart & np.uint64(0xFFFFF)) % np.uint64(k)).astype(np.int64)
        np.minimum.at(signature, place, (rank[cell].astype(np.uint64) << np.uint64(44)) | (dart >> np.uint64(20)))
        missing = (signature.reshape(texts, k) == EMPTY).any(axis=1)
        open_texts &= missing
        depth[open_texts] *= 2
    return signature.reshape(texts, k)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    total = np.zeros(parts.shape[:2], dtype=np.uint64)
    for j in range(rows):
        total += mix(parts[:, :, j], j) * ORDER[j]
    return mix(total + np.arange(bands, dtype=np.uint64) * ORDER[rows])


def signatures(documents: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id, t, s1, s2, n, bands``: a hash of the text, 128 bits of the multiset, its size, and the band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE, SLICE_ROWS):
                text, run_hash, times = shingles(words_of(part.column("text")))
                n = np.bincount(text, weights=times, minlength=part.num_rows).astype(np.int64)
                sums = []
                for seed in (11, 12):
                    edge = np.searchsorted(text, np.arange(part.num_rows))
                    value = np.r_[np.uint64(0), np.cumsum(mix(run_hash + times.astype(np.uint64) * UNIT, seed))]
                    sums.append(value[np.r_[edge[1:], len(text)]] - value[edge])
                drawn = throw(text, run_hash, times.astype(np.float64), part.num_rows, bands * rows)
                flat = longs(band_hashes(drawn, bands, rows).reshape(-1))
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands)
                columns = [part.column("id"), part.column("t"), *map(longs, sums), pa.array(n), pa.ListArray.from_arrays(offsets, flat)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "t", "s1", "s2", "n", "bands"])

    return in_batches(named(documents), run, "id long, t long, s1 long, s2 long, n long, bands array<long>")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def named(documents: DataFrame) -> DataFrame:
    """``id, t, text``: a text is named by its id and its hash."""
    return documents.select(F.col("doc_id").cast("long").alias("id"), text_hash(F.col("text")).alias("t"), F.col("text").cast("string").alias("text"))


def with_vertex(df: DataFrame, several: DataFrame | None) -> DataFrame:
    """Add ``v``: the id, or a number of its own for each text of the ids in ``several``."""
    if several is None:
        return df.withColumn("v", F.col("id"))
    own = F.xxhash64("id", "t").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    joined = df.join(several.withColumn("shared", F.lit(True)), "id", "left")
    return joined.withColumn("v", F.when(F.col("shared"), own).otherwise(F.col("id"))).drop("shared")


def multisets(documents: DataFrame, ids: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """``id, runs`` for the given vertices: sorted 32-bit hashes, a repeated run once per time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, run_hash, times = shingles(words_of(part.column("text")))
                element = np.repeat(np.arange(len(text)), times)
                unit = np.arange(len(element)) - np.repeat(np.cumsum(times) - times, times)
                value = (mix(run_hash[element] + unit.astype(np.uint64) * UNIT) >> np.uint64(32)).astype(np.uint32)
                owner = text[element]
                value = value[np.lexsort((value, owner))]
                edge = np.searchsorted(owner, np.arange(part.num_rows + 1))
                packed = [value[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(packed, pa.binary())], ["id", "runs"])

    chosen = with_vertex(named(documents), several).select(F.col("v").alias("id"), "text")
    return in_batches(chosen, run, "id long, runs binary").join(ids, "id", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose weighted Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = []
            for i in range(batch.num_rows):
                p = np.frombuffer(x[i].as_buffer(), dtype=np.uint32)
                q = np.frombuffer(y[i].as_buffer(), dtype=np.uint32)
                both = np.sort(np.concatenate((p, q)), kind="stable")
                shared = shared_count(p, q, both)
                good.append(shared >= similarity * (len(p) + len(q) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("runs").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("runs").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return in_batches(both, run, "a long, b long")


def shared_count(p: np.ndarray, q: np.ndarray, both: np.ndarray) -> int:
    """Size of the multiset intersection (hashes may repeat only by collision)."""
    same = both[1:] == both[:-1]
    if not (np.any(p[1:] == p[:-1]) or np.any(q[1:] == q[:-1])):
        return int(np.count_nonzero(same))
    values, counts = np.unique(p, return_counts=True)
    others, times = np.unique(q, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    return int(np.minimum(counts[i], times[j]).sum())


def crowd_links(wide: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that connect all similar members of crowds.

    A crowd is what wide bands ``(band, lead, id, n)`` hold together. Its members are dealt into
    blocks, and each pair of blocks is compared inside one task, which returns a spanning forest;
    rows grow with the members times the number of blocks, not with the pairs.
    """
    crowds = components(wide.select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct())
    members = checkpoint(wide.select("id", "n").distinct().join(crowds, "id").withColumnRenamed("root", "crowd"))
    blocks = members.groupBy("crowd").agg(
        F.ceil(F.greatest(F.count("*") / F.lit(float(BLOCK)), F.sum("n") / F.lit(float(BLOCK_RUNS)))).cast("int").alias("blocks")
    )
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    duels = blocks.select("crowd", "blocks", F.explode(every).alias("p1")).select(
        "crowd", "p1", F.explode(F.sequence("p1", F.col("blocks") - 1)).alias("p2")
    )
    sides = duels.select("crowd", "p1", "p2", F.col("p1").alias("part")).union(
        duels.where("p1 <> p2").select("crowd", "p1", "p2", F.col("p2").alias("part"))
    )
    dealt = members.join(blocks, "crowd").select("id", "crowd", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int").alias("part"))
    met = dealt.join(sets, "id").join(sides, ["crowd", "part"]).select("crowd", "p1", "p2", "part", "id", "runs")

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        held = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table.column("runs")]
        size = np.array([len(x) for x in held])
        parts = table.column("part").to_numpy()
        left = np.flatnonzero(parts == parts.min())
        right = np.flatnonzero(parts == parts.max())
        owner = np.repeat(np.arange(len(held)), size)
        values, column, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1  # runs of one document only cannot be shared
        both = times[column] > 1
        owner, column = owner[both], number[column[both]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((len(left), len(right)), dtype=np.float32)
        place_l, place_r = np.full(len(held), -1), np.full(len(held), -1)
        place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, (low, low + COLUMNS))
            x = np.zeros((len(held), COLUMNS), dtype=np.float32)
            x[owner[a:b], column[a:b] - low] = 1
            shared += x[left] @ x[right].T
        shared = shared.astype(np.float64)
        near = shared >= similarity * (size[left][:, None] + size[right][None, :] - shared) - 1e-9
        i, j = np.nonzero(near)
        root = forest(len(held), [(left[i], right[j])])
        keep = root != np.arange(len(held))
        return pa.table({"a": ids[keep], "b": ids[root[keep]]})

    return checkpoint(met.groupBy("crowd", "p1", "p2").applyInArrow(compare, "a long, b long"))


def near_duplicates(documents: DataFrame, similarity: float = 0.8, group: int = GROUP) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (smallest id of its class), ``kept``."""
    return classified(documents, similarity, group).select(F.col("id").alias("doc_id"), "class_id", "kept")


def classified(documents: DataFrame, similarity: float = 0.8, group: int = GROUP) -> DataFrame:
    """One row per document: ``id, t, class_id, kept``, where ``t`` is the hash of its text."""
    signed = checkpoint(signatures(documents))
    texts = signed.where("id IS NOT NULL").groupBy("id").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    several = checkpoint(texts.where("low < high").select("id"))
    several = None if several.isEmpty() else small(several)
    signed = with_vertex(signed, several)
    known = signed.where("id IS NOT NULL")
    classes = checkpoint(
        known.where("n > 0").groupBy("s1", "s2", "n").agg(F.min_by("v", "id").alias("rep"), F.min("id").alias("least"))
    )
    reps = classes.select(F.col("rep").alias("v")).distinct()
    members = checkpoint(
        known.where("n > 0").join(reps, "v", "left_semi").select(F.col("v").alias("id"), "n", F.explode("bands").alias("band")).distinct()
    )
    crowds = members.groupBy("band").agg(F.count("*").alias("crowd"), F.min(F.struct("id", "n")).alias("lead")).where("crowd > 1")
    held = checkpoint(members.join(crowds, "band"))
    fits = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb")
    few = held.where(F.col("crowd") <= group)
    one = few.select("band", F.col("id").alias("a"), F.col("n").alias("na"))
    two = few.select("band", F.col("id").alias("b"), F.col("n").alias("nb"))
    inside = one.join(two, "band").where("a < b")
    leading = held.where(F.col("crowd") > group).select(
        F.col("lead.id").alias("a"), F.col("lead.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb")
    ).where("a < b")
    tried = checkpoint(inside.select("a", "na", "b", "nb").union(leading).where(fits).select("a", "b").distinct())
    involved = held.select("id").distinct()
    sets = checkpoint(multisets(documents, involved, several).dropDuplicates(["id"]))
    links = checkpoint(verified(tried, sets, similarity))
    roots = components(links)
    wide = held.where(F.col("crowd") > group).join(roots, "id", "left").select(
        "band", "id", "n", F.coalesce("root", "id").alias("root")
    )
    mixed = wide.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("id").alias("lead")).where("low < high")
    wide = checkpoint(wide.join(mixed.select("band", "lead"), "band"))
    if not wide.isEmpty():
        roots = components(links.union(crowd_links(wide, sets, similarity)))
    # A class is named by its smallest id, and the text that stays is the representative with that id.
    if several is None:
        roots = roots.select(F.col("id").alias("rep"), F.col("root").alias("name"), F.col("root").alias("stays"))
    else:
        held = roots.withColumnRenamed("id", "rep").join(classes.select("rep", "least"), "rep")
        best = held.groupBy("root").agg(F.min(F.struct("least", "rep")).alias("best"))
        roots = held.join(best, "root").select("rep", F.col("best.least").alias("name"), F.col("best.rep").alias("stays"))
    found = signed.select("id", "t", "v", "s1", "s2", "n").join(classes, ["s1", "s2", "n"], "left").join(roots, "rep", "left")
    named_class = F.when(F.col("id").isNotNull(), F.coalesce("name", "least", "id"))
    kept = F.col("id").isNull() | (F.col("v") == F.coalesce("stays", "rep", "v"))
    return found.select("id", "t", named_class.alias("class_id"), kept.alias("kept"))


def deduplicated(documents: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents that stay: one text of each class, from its smallest id, once."""
    of, at = free_name(documents, "of"), free_name(documents, "at")
    dropped = classified(documents, similarity).where("NOT kept").select(F.col("id").alias(of), F.col("t").alias(at)).distinct()
    keyed = documents.where("doc_id IS NOT NULL").withColumns({of: F.col("doc_id").cast("long"), at: text_hash(F.col("text"))})
    stay = keyed.join(dropped, [of, at], "left_anti").dropDuplicates([of, at]).drop(of, at)
    return stay.unionByName(documents.where("doc_id IS NULL")).select(*[F.col(f"`{c}`") for c in documents.columns])
