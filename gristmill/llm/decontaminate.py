"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND.

Every document is cut into overlapping passages, every passage is a query, and every item
whose score reaches the item's own threshold is retrieved and then verified on words. The
threshold is not a guess: a passage that holds at least ``similarity`` of an item's five-word
runs misses at most as many of its words as runs, so its score is at least the item's score of
itself less its largest contributions. Nothing that would verify is therefore pruned.

Words are maximal runs of letters and digits, in lower case (ASCII and Latin-1). An item is
verified when the passage holds ``similarity`` of its five-word runs and its answer, which is its
last sentence: either the same share of the runs that touch it, or its words in order with at
most one of them (in long answers the rest of that share) changed, lost or added.

Defined cases: null and empty texts match nothing; items with fewer than five words cannot be
told from ordinary prose and are not indexed; repeated rows are judged alike; an empty benchmark
leaves every document clean. Items are read by the driver in shards of bounded size; a larger
benchmark means more passes over the documents, never a larger broadcast.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gristmill.llm.tables import in_batches
from gristmill.llm.words import cut, hash_words, slices, text_bytes

RUN = 5
SHARD_ITEMS = 20_000
SHARD_CHARS = 32 << 20
K1, B = 1.2, 0.75
BLOCK = 4
PRESENT = 1 << 20
COMMON = 0.02  # share of the items above which a word counts as common
LEAST_WINDOW = 64

# Letters, digits and all bytes of multi-byte characters belong to words.
GAP = np.ones(256, dtype=bool)
GAP[ord("0") : ord("9") + 1] = False
GAP[ord("a") : ord("z") + 1] = False
GAP[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, byte by byte."""
    out = LOWER[data]
    if len(data) > 1:
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][wide] += 0x20
    return out


def tokens(text: str) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    words = cut(folded(raw), np.array([0, len(raw)]), GAP)
    return [words.word(i) for i in range(len(words.starts))]


def word_runs(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + RUN]) for i in range(len(words) - RUN + 1)]


def answer_length(text: str) -> int:
    """Words of the last sentence of ``text``."""
    body = (text or "").rstrip(" \t\r\n.!?")
    last = max(body.rfind(c) for c in ".!?\n")
    return len(tokens(body[last + 1 :]))


def edits_within(part: np.ndarray, whole: np.ndarray) -> int:
    """Least number of words to change, lose or add until ``part`` stands in one piece in ``whole``."""
    cost = np.zeros(len(whole) + 1, dtype=np.int64)
    step = np.arange(len(whole) + 1)
    for n, word in enumerate(part, 1):
        above = np.concatenate([[n], np.minimum(cost[:-1] + (whole != word), cost[1:] + 1)])
        # An added word costs one more than the cell to its left: a running minimum along the row.
        cost = np.minimum.accumulate(above - step) + step
    return int(cost.min())


@dataclass
class Index:
    """Items of similar length: postings in item order, maxima of blocks, and thresholds."""

    ids: list[int]
    runs: list[set]
    answers: list[set]
    tails: list  # word hashes of the answers, in order
    window: int
    vocabulary: np.ndarray  # sorted word hashes
    present: np.ndarray  # low bits of the hashes that occur
    postings: list  # per word: item numbers, contributions, largest contribution by block
    rare: np.ndarray  # words that few items share
    floor: np.ndarray  # threshold of each item
    need: np.ndarray  # what rare words must contribute at least to reach it
    block_need: np.ndarray  # the least need in each block of items
    block_first: np.ndarray  # per word: where its blocks start in the next two, rare words only
    block_of: np.ndarray
    block_max: np.ndarray


def build(items: list[tuple[int, str]], similarity: float) -> list[Index]:
    """Indexes by class of item lengths (powers of four), so that windows fit.

    Items of common words only get an index of their own: they cannot be looked for by rare
    words, and would otherwise weaken the pruning for all others.
    """
    classes = defaultdict(list)
    for item, text in sorted(items, key=lambda x: (x[0], x[1] or "")):
        words = tokens(text)
        if len(words) >= RUN:
            size = LEAST_WINDOW
            while size < len(words):
                size *= 4
            classes[size].append((item, words, answer_length(text)))
    out = []
    for size, members in sorted(classes.items()):
        index = index_of(members, size, similarity)
        easy = index.need >= index.floor / 4
        for group, share in ((easy, COMMON), (~easy, 1.0)):
            part = [m for m, x in zip(members, group) if x]
            if part:
                index = index_of(part, size, similarity, share)
                # Where common words alone may reach a threshold, all words are looked up.
                out.append(index if index.need.min() > 0 else index_of(part, size, similarity, 1.0))
    return out


def index_of(members: list, window: int, similarity: float, share: float = COMMON) -> Index:
    frequency = Counter(w for _, words, _ in members for w in set(words))
    average = sum(len(words) for _, words, _ in members) / len(members)
    common = max(2, share * len(members))
    found, floor, need, runs, answers, tails = defaultdict(list), [], [], [], [], []
    for number, (_, words, tail) in enumerate(members):
        gains, shared = [], 0.0
        for word, tf in Counter(words).items():
            idf = np.log1p((len(members) - frequency[word] + 0.5) / (frequency[word] + 0.5))
            gain = float(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average)))
            found[word].append((number, gain))
            gains.append(gain)
            shared += gain * (frequency[word] > common)
        own = word_runs(words)
        missed = int((1 - similarity) * len(set(own)) + 1e-9)
        # A missing word takes at least one run with it, wherever it stands.
        gains.sort()
        floor.append(sum(gains[: max(1, len(gains) - missed)]) * (1 - 1e-9))
        need.append(max(0.0, floor[-1] - shared))
        runs.append(set(own))
        answers.append(set(own[-max(1, min(tail, len(own))) :]))
        tails.append(np.array([hash_bytes(word) for word in words[-max(1, tail) :]], dtype=np.uint64))
    raw = sorted((int(hash_bytes(word)), word) for word in found)
    postings, rare, first, of, most = [], [], [0], [], []
    for _, word in raw:
        maxima: dict[int, float] = {}
        for number, gain in found[word]:
            maxima[number // BLOCK] = max(gain, maxima.get(number // BLOCK, 0.0))
        postings.append((np.array([n for n, _ in found[word]]), np.array([g for _, g in found[word]]), maxima))
        rare.append(frequency[word] <= common)
        if rare[-1]:
            of += maxima.keys()
            most += maxima.values()
        first.append(len(of))
    hashes = np.array([h for h, _ in raw], dtype=np.uint64)
    present = np.zeros(PRESENT, dtype=bool)
    present[(hashes & np.uint64(PRESENT - 1)).astype(np.int64)] = True
    return Index(
        [m[0] for m in members], runs, answers, tails, window, hashes, present, postings, np.array(rare), np.array(floor),
        np.array(need), np.minimum.reduceat(need, np.arange(0, len(need), BLOCK)), np.array(first),
        np.array(of, dtype=np.int64), np.array(most),
    )


def hash_bytes(word: bytes) -> np.uint64:
    return hash_words(np.frombuffer(word, dtype=np.uint8), np.array([0]), np.array([len(word)]))[0]


def wand(index: Index, terms: list[int], block: int) -> list[tuple[int, float]]:
    """Items of one block whose score of ``terms`` reaches their threshold, by WAND.

    Lists are kept by their current item. The pivot is the first item at which the largest
    contributions that the lists make inside the block reach the smallest threshold; lists
    before it jump to it, and an item is scored only when all of them stand on it.
    """
    start, stop = block * BLOCK, (block + 1) * BLOCK
    least = float(index.floor[start:stop].min())
    lists = []
    for term in terms:
        numbers, gains, maxima = index.postings[term]
        if block in maxima:
            low, high = np.searchsorted(numbers, (start, stop))
            lists.append([numbers[low:high].tolist(), gains[low:high].tolist(), maxima[block], 0])
    out = []
    while lists:
        lists.sort(key=lambda x: x[0][x[3]])
        reach, pivot = 0.0, -1
        for k, entry in enumerate(lists):
            reach += entry[2]
            if reach >= least:
                pivot = k
                break
        if pivot < 0:
            break
        item = lists[pivot][0][lists[pivot][3]]
        if lists[0][0][lists[0][3]] == item:
            score = 0.0
            for entry in lists:
                if entry[0][entry[3]] != item:
                    break
                score += entry[1][entry[3]]
                entry[3] += 1
            if score >= index.floor[item]:
                out.append((item, score))
        else:
            for entry in lists[:pivot]:
                while entry[3] < len(entry[0]) and entry[0][entry[3]] < item:
                    entry[3] += 1
        lists = [x for x in lists if x[3] < len(x[0])]
    return out


def candidates(index: Index, at: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, block of items) whose block maxima of rare words reach what some item needs.

    ``at`` are the places of rare words and ``place`` their terms; passages are ``[low, high)``
    in order. A word counts once per passage.
    """
    first, last = np.searchsorted(at, low), np.searchsorted(at, high)
    n = last - first
    passage = np.repeat(np.arange(len(low)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    pair = np.unique(passage * len(index.vocabulary) + place[inside])
    passage, term = pair // len(index.vocabulary), pair % len(index.vocabulary)
    n = index.block_first[term + 1] - index.block_first[term]
    spread = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.block_first[term], n)
    key = np.repeat(passage, n) * len(index.block_need) + index.block_of[spread]
    order = np.argsort(key, kind="stable")
    key, gain = key[order], index.block_max[spread][order]
    if not len(key):
        return key, key
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, total = key[edge], np.add.reduceat(gain, edge)
    good = total >= index.block_need[key % len(index.block_need)]
    return key[good] // len(index.block_need), key[good] % len(index.block_need)


def search(words, hashes: np.ndarray, index: Index, similarity: float) -> list[tuple[int, int, float]]:
    """(text number, item number, score) of all verified items in the texts of a slice."""
    if not len(hashes):
        return []
    at = np.flatnonzero(index.present[(hashes & np.uint64(PRESENT - 1)).astype(np.int64)])
    place = np.searchsorted(index.vocabulary, hashes[at])
    place[place == len(index.vocabulary)] = 0
    hit = index.vocabulary[place] == hashes[at]
    at, place = at[hit], place[hit]
    counts = words.counts
    per_text = np.maximum(1, -(-counts // index.window) - 1) * (counts >= RUN)
    texts = np.repeat(np.arange(len(counts)), per_text)
    step = np.arange(len(texts)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    low = words.first[texts] + step * index.window
    high = np.minimum(low + 2 * index.window, words.first[texts + 1])
    rare = index.rare[place]
    found, held = [], {}
    for k, block in zip(*candidates(index, at[rare], place[rare], low, high)):
        a, b = np.searchsorted(at, (low[k], high[k]))
        for item, score in wand(index, np.unique(place[a:b]).tolist(), int(block)):
            if k not in held:
                held = {k: set(word_runs([words.word(i) for i in range(low[k], high[k])]))}
            if verified(index, item, held[k], hashes[low[k] : high[k]], similarity):
                found.append((int(texts[k]), item, score))
    return found


def verified(index: Index, item: int, held: set, passage: np.ndarray, similarity: float) -> bool:
    """Whether a passage (its runs and word hashes) holds the item and its answer."""
    whole, answer = (len(p & held) >= similarity * len(p) - 1e-9 for p in (index.runs[item], index.answers[item]))
    if answer or not whole:
        return answer and whole
    tail = index.tails[item]
    return edits_within(tail, passage) <= max(1, int((1 - similarity) * len(tail) + 1e-9))


def shards(benchmark: DataFrame, items: int, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of bounded length and size, read one at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").toLocalIterator():
        if held and (len(held) >= items or size + len(row[1]) > chars):
            yield held
            held, size = [], 0
        held.append((row[0] if row[0] is not None else -1, row[1]))
        size += len(row[1])
    yield held


def contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.8, keep: tuple[str, ...] = ("doc_id",), shard_items: int = SHARD_ITEMS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``keep`` columns with ``items`` (sorted ids of the items found) and ``best_score``.

    ``items`` is empty for clean documents. ``keep`` may include the text itself.
    """
    names = [f"k{i}" for i in range(len(keep))]
    rows = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col("text").cast("string").alias("body"))
    rows = rows.withColumns({"items": F.array().cast("array<long>"), "best_score": F.lit(0.0)})
    schema = rows.drop("body").schema
    if "text" in keep:
        rows = rows.withColumn("body", F.lit(None).cast("string"))
    body = names[list(keep).index("text")] if "text" in keep else "body"
    for held in shards(benchmark, shard_items, shard_chars):
        indexes = documents.sparkSession.sparkContext.broadcast(build(held, similarity))
        rows = in_batches(rows, matcher(indexes, similarity, body), rows.schema)
    return rows.select(schema.names).toDF(*keep, "items", "best_score")


def matcher(indexes, similarity: float, body: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, body):
                data, offsets = text_bytes(part.column(body))
                words = cut(folded(data), offsets, GAP)
                hashes = words.hashes()
                items = [set(x) for x in part.column("items").to_pylist()]
                score = part.column("best_score").to_pylist()
                for index in indexes.value:
                    for text, item, value in search(words, hashes, index, similarity):
                        items[text].add(index.ids[item])
                        score[text] = max(score[text], value)
                columns = dict(zip(part.schema.names, part.columns))
                columns["items"] = pa.array([sorted(x) for x in items], pa.list_(pa.int64()))
                columns["best_score"] = pa.array(score, pa.float64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def clean(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents without any verified item, in their own columns."""
    inner = [f"c{i}" if c != "text" else "text" for i, c in enumerate(documents.columns)]
    judged = contaminated(documents.toDF(*inner), benchmark, similarity, tuple(inner))
    return judged.where(F.size("items") == 0).select(*inner).toDF(*documents.columns)

