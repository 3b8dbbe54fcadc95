"""Substring dedup: words covered by a window that an earlier document has are removed.

A window is a run of ``window`` words. Suffix automata of reference shards give every piece of
text its matching statistics: for each place, whether the window that ends there was read before,
and in which document first. To keep the automata small, only what can repeat is read into them:

1. Every window names the least hash among its five-word runs, its anchor. Equal windows have
   equal anchors, so an anchor that only one document has rules all its windows out. This takes
   one grouped count over all documents.
2. Neighbouring windows with a shared anchor form a piece of text, named by a 128-bit hash of its
   words. If all pieces of an anchor are equal, their windows are its first document's.
3. Where an anchor has several different pieces, the first document of each sends its words.
   Rows that repeat an id send theirs as one. They are dealt into shards by anchor. One task builds the automaton of a shard, in the order
   of first documents, and streams the shard's pieces through it. An anchor with very many
   different pieces would make a shard too large: its windows are grouped one by one instead.
4. Each document gets the windows to remove back as bit masks, and is read a last time.

No stage gathers a document's or anchor's occurrences in one task beyond a stated bound: counts
are aggregated partially, equal pieces meet as one row per task, and joins on hot pieces are split
by adaptive skew handling. Documents are dealt by id once; later steps read the same exchange.

Defined cases: a null text has no words; a null id counts as larger than any other, and null ids
are ordered among themselves by a hash of the text; texts that share an id are judged each for
itself, and none of them is earlier than the other; repeated rows are judged alike; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gristmill.llm.tables import in_batches, settled, small
from gristmill.llm.words import Words, longs, mix, runs, slices, span_hashes, words_of

WINDOW, RUN = 13, 5
PIECE = 64  # windows in a piece at most, the bits of a mask
CROWD = 1_000  # different pieces of an anchor beyond which its windows are grouped one by one
SHARD = 4_000  # pieces in a shard on average
LARGEST = (1 << 63) - 1


def anchors(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and anchor of every window."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    run = np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    value, at = runs(words, hashes, RUN)
    run[at] = value
    m = n - window + 1
    least, reach = run, 1  # the least of ``reach`` runs, doubled as long as it fits
    while 2 * reach <= window - RUN + 1:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    rest = window - RUN + 1 - reach
    least = np.minimum(least[:m], least[rest : rest + m])
    limit = np.repeat(words.first[1:], words.counts)[:m]
    start = np.flatnonzero(np.arange(m) + window <= limit)
    return start, least[start]


def keyed(documents: DataFrame) -> list[Column]:
    """``doc``, ``copy`` and ``text``; for a null id a large number from the text stands in.

    Different texts may share an id, so a text is named by its id and its hash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stand_in = F.lit(LARGEST) - F.pmod(F.xxhash64(text), F.lit(1 << 40))
    return [F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text")]


def changes(*keys: np.ndarray) -> np.ndarray:
    """Places at which any of the keys differs from the place before."""
    if not len(keys[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def document_anchors(texts: DataFrame, window: int) -> DataFrame:
    """``anchor, doc, copy``, each once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                start, anchor = anchors(words, words.hashes(), window)
                owner = words.owner()[start]
                heads = changes(anchor, owner)
                owner, anchor = owner[heads], anchor[heads]
                order = np.lexsort((anchor, owner))
                owner, anchor = owner[order], anchor[order]
                first = changes(anchor, owner)
                ids, copies = (part.column(c).to_numpy(zero_copy_only=False)[owner[first]] for c in ("doc", "copy"))
                yield pa.RecordBatch.from_arrays([longs(anchor[first]), pa.array(ids), pa.array(copies)], ["anchor", "doc", "copy"])

    return in_batches(texts, run, "anchor long, doc long, copy long")


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each; null lists are empty."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return values, np.repeat(np.arange(len(column)), sizes)


def among(values: np.ndarray, rows: np.ndarray, known: np.ndarray, known_rows: np.ndarray) -> np.ndarray:
    """Which of the values are in the list of their row."""
    salt = np.uint64(0x9FB21C651E98DF25)
    listed = np.sort(mix(known + known_rows.astype(np.uint64) * salt))
    if not len(listed):
        return np.zeros(len(values), dtype=bool)
    own = mix(values + rows.astype(np.uint64) * salt)
    place = np.searchsorted(listed, own)
    place[place == len(listed)] = 0
    return listed[place] == own


def rows_with(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    """The rows whose ``column`` is not null: only they have anything to cut."""
    return batch.filter(batch.column(column).is_valid())


def cut_pieces(part: pa.RecordBatch, window: int) -> tuple:
    """Words of the texts of a batch, and its pieces: text, first word, windows, anchor, p1, p2."""
    words = words_of(part.column("text"))
    hashes, owner = words.hashes(), words.owner()
    start, anchor = anchors(words, hashes, window)
    of = owner[start]
    # Neighbouring windows of one text with one anchor are looked up together.
    heads = changes(anchor, of, start - np.arange(len(start)))
    sizes = np.diff(np.r_[heads, len(start)])
    hit = among(anchor[heads], of[heads], *flat_lists(part.column("shared")))
    heads, sizes = heads[hit], sizes[hit]
    n = -(-sizes // PIECE)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    opened = np.repeat(heads, n)
    low = start[opened] + nth * PIECE
    windows = np.minimum(PIECE, np.repeat(sizes, n) - nth * PIECE)
    p1, p2 = (span_hashes(hashes, low, low + windows + window - 1, s) for s in (1, 2))
    return words, of[opened], low, windows, anchor[opened], p1, p2


def occurrences(listed: DataFrame, window: int) -> DataFrame:
    """Where the pieces of ``listed(doc, copy, text, shared)`` stand, without their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(rows_with(batch, "shared"), "text"):
                words, of, low, windows, anchor, p1, p2 = cut_pieces(part, window)
                ids, copies = (part.column(c).to_numpy(zero_copy_only=False)[of] for c in ("doc", "copy"))
                columns = [
                    longs(anchor), longs(p1), longs(p2), pa.array(ids), pa.array(copies),
                    pa.array((low - words.first[of]).astype(np.int32)), pa.array(windows.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "p1", "p2", "doc", "copy", "start", "windows"])

    return in_batches(listed, run, "anchor long, p1 long, p2 long, doc long, copy long, start int, windows int")


def asked_words(listed: DataFrame, window: int) -> DataFrame:
    """``anchor, p1, p2, first, words`` of the pieces whose ``p1`` is in ``asked``, once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(rows_with(batch, "asked"), "text"):
                words, of, low, windows, anchor, p1, p2 = cut_pieces(part, window)
                wanted = np.flatnonzero(among(p1, of, *flat_lists(part.column("asked"))))
                wanted = wanted[np.sort(np.unique(mix(p1[wanted] + of[wanted].astype(np.uint64)), return_index=True)[1])]
                data, begins, ends = words.data.tobytes(), words.starts, words.ends
                said = []
                for k in wanted:
                    a, b = low[k], low[k] + windows[k] + window - 1
                    said.append(b" ".join(data[x:y] for x, y in zip(begins[a:b].tolist(), ends[a:b].tolist())).decode())
                ids = part.column("doc").to_numpy(zero_copy_only=False)
                columns = [longs(anchor[wanted]), longs(p1[wanted]), longs(p2[wanted]), pa.array(ids[of[wanted]]), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "p1", "p2", "first", "words"])

    return in_batches(listed, run, "anchor long, p1 long, p2 long, first long, words string")


class Automaton:
    """Suffix automaton of word sequences read in the order of their documents.

    ``document[s]`` is the first document with the sequences of state ``s``.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.document = [-1], [0], [-1]

    def add(self, sequence: list, document: int) -> None:
        last = 0
        for word in sequence:
            last = self.extend(last, word, document)

    def state(self, length: int, link: int, document: int, out: dict) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        self.document.append(document)
        return len(self.next) - 1

    def split(self, p: int, word, q: int) -> int:
        """The state of the longest sequence that ends with ``word`` after state ``p``."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self.state(self.length[p] + 1, self.link[q], self.document[q], dict(self.next[q]))
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, word, document: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self.split(last, word, known)
        new = self.state(self.length[last] + 1, 0, document, {})
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self.split(p, word, self.next[p][word])
        return new

    def statistics(self, sequence: list, window: int) -> list[int]:
        """For each window of the sequence: the first document that has it, or -1."""
        out, state, length = [], 0, 0
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
            length = min(length, window)
            if i + 1 >= window:
                out.append(self.document[state] if length == window else -1)
        return out


def read_shard(window: int):
    def run(table: pa.Table) -> pa.Table:
        first = table.column("first").to_pylist()
        words = table.column("words").to_pylist()
        anchor = table.column("anchor").to_pylist()
        order = sorted(range(len(first)), key=lambda i: (anchor[i], first[i]))
        found: list = [None] * len(first)
        low = 0
        while low < len(order):  # equal windows have equal anchors: one automaton for each anchor
            high = low
            while high < len(order) and anchor[order[high]] == anchor[order[low]]:
                high += 1
            machine, held = Automaton(), []
            for i in order[low:high]:
                held.append(words[i].split(" "))
                machine.add(held[-1], first[i])
            for i, sequence in zip(order[low:high], held):
                found[i] = machine.statistics(sequence, window)
            low = high
        return table.select(["anchor", "p1", "p2"]).append_column("firsts", pa.array(found, pa.list_(pa.int64())))

    return run


def first_documents(said: DataFrame, crowded: DataFrame, pieces: int, window: int, shard: int) -> DataFrame:
    """``anchor, p1, p2, firsts``: the first document of each window of the pieces ``said``.

    Words travel once, to the shard of their anchor; only the crowded anchors are looked up.
    """
    shards = max(1, math.ceil(pieces / shard))
    dealt = said.join(crowded, "anchor", "left_anti").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    read = dealt.groupBy("shard").applyInArrow(read_shard(window), "anchor long, p1 long, p2 long, firsts array<long>")
    many = said.join(crowded, "anchor", "left_semi").withColumn("w", F.split("words", " "))
    single = many.select("anchor", "p1", "p2", "first", "w", F.explode(F.sequence(F.lit(0), F.size("w") - window)).alias("at"))
    single = single.select("anchor", "p1", "p2", "first", "at", F.array_join(F.slice("w", F.col("at") + 1, window), " ").alias("window"))
    least = single.groupBy("window").agg(F.min("first").alias("least"))
    ruled = single.join(least, "window").groupBy("anchor", "p1", "p2").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "least"))), lambda x: x["least"]).alias("firsts")
    )
    return read.union(ruled)


def removals(documents: DataFrame, window: int = WINDOW, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """``doc, text, places``: per document the removed windows as ``(start, mask)`` pairs."""
    texts = documents.select("doc_id", *keyed(documents))
    grams = document_anchors(texts.select("doc", "copy", "text"), window)
    shared = grams.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor")
    # Each task hashes its share of the distinct anchors instead of sorting all.
    lists = settled(grams.join(shared.hint("shuffle_hash"), "anchor", "left_semi").groupBy("doc", "copy").agg(F.collect_list("anchor").alias("shared")))
    # With its id, though unused there, each pass reads the exchange that the last join reads.
    listed = texts.join(lists, ["doc", "copy"], "left").select("doc_id", "doc", "copy", "text", "shared")
    # Read twice, so written once, as are the words below.
    found = settled(occurrences(listed, window))
    different = settled(found.groupBy("anchor", "p1", "p2").agg(F.min("doc").alias("first"), F.min_by("copy", "doc").alias("copy"), F.max("windows").alias("windows")))
    counts = different.groupBy("anchor").agg(F.count("*").alias("n"))
    sized = settled(different.join(counts, "anchor"))
    # All windows of a piece that is alone have its first document.
    alone = sized.where("n = 1").select("anchor", "p1", "p2", F.col("first").alias("low"), F.lit(None).cast("array<long>").alias("firsts"))
    several = sized.where("n > 1")
    crowded = small(several.where(F.col("n") > crowd).select("anchor").distinct())
    asked = several.groupBy(F.col("first").alias("doc"), "copy").agg(F.collect_list("p1").alias("asked"))
    # Rows that repeat an id say the same words. All columns are keys: equal pieces agree in the rest, and rows of keys alone are not sorted.
    said = settled(asked_words(listed.join(asked, ["doc", "copy"], "left"), window).dropDuplicates())
    ruled = first_documents(said, crowded, several.count(), window, shard)
    firsts = alone.union(ruled.select("anchor", "p1", "p2", F.array_min("firsts").alias("low"), "firsts"))
    every = F.when(F.col("windows") < 64, F.expr("~shiftleft(-1L, windows)")).otherwise(F.lit(-1).cast("long"))
    bits = F.transform("firsts", lambda f, i: F.when(f < F.col("doc"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    some = F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    masks = (
        found.join(firsts, ["anchor", "p1", "p2"]).where("low < doc")
        .select("doc", "copy", "start", F.when(F.col("firsts").isNull(), every).otherwise(some).alias("mask"))
    )
    places = masks.groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "mask")).alias("places"))
    return texts.join(places, ["doc", "copy"], "left")


def kept_words(text: str, places: np.ndarray, window: int) -> tuple[list[bytes], int]:
    """Words of a text that no removed window covers, and the number of all words.

    ``places`` are the first words of the removed windows.
    """
    words = text.encode().split()  # bytes part at \x20 and \x09-\x0D only
    if not len(places):
        return words, len(words)
    size = len(words) + 1
    cover = np.bincount(places, minlength=size) - np.bincount(np.minimum(places + window, len(words)), minlength=size)
    left = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
    return [words[i] for i in left.tolist()], len(words)


def removed_windows(column: pa.Array) -> list[np.ndarray]:
    """First words of the removed windows of each row, from its ``(start, mask)`` pairs."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    pairs = column.flatten()
    starts, masks = (pairs.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "mask"))
    bits = np.unpackbits(masks.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pair, skip = np.nonzero(bits)
    ends = np.r_[0, np.cumsum(bits.sum(axis=1, dtype=np.int64))][np.cumsum(sizes)]
    return np.split(starts[pair] + skip, ends[:-1])


def without_repeats(documents: DataFrame, window: int = WINDOW, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the kept words of each document, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, removed, kept = [], [], []
                for text, places in zip(part.column("text").to_pylist(), removed_windows(part.column("places"))):
                    left, size = kept_words(text, places, window)
                    n.append(size)
                    removed.append(size - len(left))
                    kept.append(b" ".join(left).decode())
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    judged = removals(documents, window, crowd, shard).select("doc_id", "text", "places")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return in_batches(judged, run, f"doc_id {kind}, n_words long, n_removed long, kept string")

