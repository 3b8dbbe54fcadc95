"""Cross-tokenizer alignment with pair counts behind a minimal perfect hash.

Two tokenizers encode the same bytes; the places where tokens of both end cut a document into
groups, and two tokens are linked where their byte ranges overlap. How often a pair of ids is
linked is counted in documents, corpus-wide:

1. A first pass aligns every document and leaves, per task, each pair with its number of documents.
2. The distinct pairs get a minimal perfect hash. It is built per shard, inside a task: every level
   is a bit field that keeps the keys which are alone on their bit, the others move on to the next
   level; a key's number is the number of set bits before its own. A shard holds the pairs of some
   ids of the first tokenizer, so its size is bounded by the shard size and the second vocabulary.
3. Tasks write counts into dense vectors indexed by that number, and the vectors are summed as a
   tree of bounded fan-in, block by block.
4. A second pass aligns the documents again and looks the counts up. A key found under its number
   is compared with the key asked for.

Tokens never cross a blank that follows a character other than a blank (the merges are checked
for that when a tokenizer is read), so a text is cut there into units, and units repeat. Each
distinct unit of a slice is encoded once and a Python worker remembers the units it met, from task
to task and up to a bound.

The tables of the second pass are sent to the executors in portions of bounded bytes. Vocabularies
bound them and not the corpus; where one portion is not enough, the documents are aligned once
more for each further portion and the sums are carried along.

Defined cases: a text that is null, empty, or not given back byte by byte by both tokenizers has
no tokens, zeros and an empty group string; a null id is kept; repeated rows count as documents of
their own; an empty table gives an empty result; texts of any length are worked through unit by
unit; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gristmill.llm.tables import in_batches
from gristmill.llm.words import mix, slices
from gristmill.plans.session import checkpoint, shuffle_partitions

MARK = "▁"
#: A blank that starts a unit stands after a character that no definition of white space includes.
UNIT = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")
BLANK_BEFORE_BLANK = re.compile(r"\s ")
#: Units, and characters of units, that a Python worker remembers before it starts anew.
REMEMBERED, REMEMBERED_CHARACTERS = 700_000, 24 << 20
#: Units that are looked up, encoded and joined at a time.
UNITS_AT_ONCE = 100_000
#: Characters of units that are encoded as one text.
TEXT_AT_ONCE = 2_000
#: Pairs a task counts before it hands them on.
PAIRS_AT_ONCE = 2_000_000
SHARD_PAIRS = 500_000
BLOCK = 1 << 16
FAN_IN = 32
#: Bytes of keys, counts and hashes that are broadcast at a time.
PORTION_BYTES = 64 << 20
BYTES_PER_PAIR = 17
GAMMA = 2
SHIFT = 32


@dataclass(frozen=True)
class Tokenizers:
    """Paths of a byte-level BPE file and of a sentencepiece file; a Python worker reads them once."""

    byte_level: str
    pieces: str


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others follow in order from code point 256.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, paths: Tokenizers):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(paths.byte_level)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        letters = byte_letters()
        special = self.a.get_added_tokens_decoder()
        written = {i: t.encode() if i in special else bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [written.get(i, b"") for i in range(max(written) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths.pieces)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(" " in p or MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces with a blank after another character are not supported")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # An id as it is written before a further one, and as the last of its side of a group.
        self.a_written, self.b_written = (np.array([f"{i}{end}" for i in range(len(x)) for end in ends], object) for x, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, given without the blank they start with, from both sides, end to end.

        Units stand together in one text as they do in a document, as long as each ends with
        something other than a blank; so the tokenizers are called once for many units.
        """
        texts, begun, size = [], 0, 0
        for i, unit in enumerate(units):
            size += len(unit)
            if size >= TEXT_AT_ONCE or not unit or unit[-1].isspace():
                texts.append(" ".join(units[begun : i + 1]))
                begun, size = i + 1, 0
        if begun < len(units):
            texts.append(" ".join(units[begun:]))
        left = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        # The second tokenizer adds the blank itself. An empty text has no pieces; as the end of a longer one it is the blank alone.
        blank = [self.b.piece_to_id(MARK)]
        right = [ids or blank for ids in self.b.encode(texts, num_threads=1)]
        return tuple(np.array(list(chain.from_iterable(side)), np.int64) for side in (left, right))

    def given_back(self, unit: str) -> bool:
        """Whether both sides give back the bytes of one unit."""
        a, b = self.encode([unit])
        return f" {unit}".encode() == joined(self.a_bytes, a) == joined(self.b_bytes, b)


def joined(written: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(written.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def pair_of(paths: Tokenizers) -> Pair:
    return Pair(paths)


class Alignments:
    """Units aligned together: their bytes are laid end to end, so ends of tokens are places on one line."""

    def __init__(self, pair: Pair, units: list[str]):
        self.pair, self.units = pair, units
        self.raws = [f" {u}".encode() for u in units]
        self.a, self.b = pair.encode(units)
        self.a_ends, self.b_ends = np.cumsum(pair.a_length[self.a]), np.cumsum(pair.b_length[self.b])
        self.unit_ends = np.cumsum(np.fromiter(map(len, self.raws), np.int64, len(units)))

    def __len__(self) -> int:
        return len(self.units)

    def give_back(self) -> bool:
        """Whether all units come back byte by byte, from both sides, and end with a token."""
        whole = all(np.isin(self.unit_ends, ends).all() for ends in (self.a_ends, self.b_ends))
        return whole and b"".join(self.raws) == joined(self.pair.a_bytes, self.a) == joined(self.pair.b_bytes, self.b)

    @cached_property
    def n_a(self) -> np.ndarray:
        return self.per_unit(self.a_ends)

    @cached_property
    def n_b(self) -> np.ndarray:
        return self.per_unit(self.b_ends)

    def per_unit(self, ends: np.ndarray) -> np.ndarray:
        """How many of the sorted places lie in each unit."""
        return np.diff(np.searchsorted(ends, self.unit_ends, side="right"), prepend=0)

    @cached_property
    def cuts(self) -> np.ndarray:
        """Places where a token of either side ends. The stretch before each lies in one token of each side."""
        return np.union1d(self.a_ends, self.b_ends)

    @cached_property
    def links(self) -> np.ndarray:
        """Keys of all pairs of tokens that share a byte, unit by unit."""
        return self.a[np.searchsorted(self.a_ends, self.cuts)] << SHIFT | self.b[np.searchsorted(self.b_ends, self.cuts)]

    @cached_property
    def n_links(self) -> np.ndarray:
        return self.per_unit(self.cuts)

    @cached_property
    def group_ends(self) -> np.ndarray:
        return np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)

    @cached_property
    def n_groups(self) -> np.ndarray:
        return self.per_unit(self.group_ends)

    def groups(self) -> list[str]:
        """The groups of each unit, written out: ids of a group stand together, first those of one side, then the others."""
        in_a, in_b = np.searchsorted(self.group_ends, self.a_ends), np.searchsorted(self.group_ends, self.b_ends)
        written = np.empty(len(self.a) + len(self.b), object)
        last_a, last_b = (np.diff(x, append=len(self.group_ends)) != 0 for x in (in_a, in_b))
        written[np.arange(len(self.a)) + np.searchsorted(in_b, in_a, side="left")] = self.pair.a_written[2 * self.a + last_a]
        written[np.arange(len(self.b)) + np.searchsorted(in_a, in_b, side="right")] = self.pair.b_written[2 * self.b + last_b]
        stream = written.tolist()
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(stream[low:high])[:-1] for low, high in zip([0, *ends], ends)]


def units_of(text: str) -> Iterator[list[str]]:
    """Units of ``" " + text`` without the blank each starts with, in portions."""
    spaced = " " + text
    if len(text) > 8 * UNITS_AT_ONCE:
        found = (m.group()[1:] for m in UNIT.finditer(spaced))
        while portion := list(islice(found, UNITS_AT_ONCE)):
            yield portion
    elif BLANK_BEFORE_BLANK.search(spaced):
        yield [u[1:] for u in UNIT.findall(spaced)]
    else:
        yield text.split(" ")


class Aligner:
    """Numbers of units, given out as units are met."""

    def __init__(self, paths: Tokenizers):
        self.pair = pair_of(paths)
        self.memory: dict[str, int] = {}
        self.characters = self.given = 0

    def portions(self, texts: list[str | None]) -> Iterator[tuple[list[tuple[int, list[str]]], bool]]:
        """Rows and their units, many at a time; a long text comes in several portions.

        With each portion: whether the memory was emptied before it, so that numbers begin anew.
        """
        held: list[tuple[int, list[str]]] = []
        size = 0
        for row, text in enumerate(texts):
            for units in units_of(text) if text else ():
                held.append((row, units))
                size += len(units)
                if size >= UNITS_AT_ONCE:
                    yield held, self.emptied()
                    held, size = [], 0
        if held:
            yield held, self.emptied()

    def emptied(self) -> bool:
        if len(self.memory) < REMEMBERED and self.characters < REMEMBERED_CHARACTERS:
            return False
        self.forget()
        return True

    def forget(self) -> None:
        self.memory.clear()
        self.characters = self.given = 0

    def learn(self, held: list[tuple[int, list[str]]]) -> Alignments:
        """Number the new units, -1 for those whose bytes are changed; the alignments of the numbers given out."""
        memory, pair = self.memory, self.pair
        met = dict.fromkeys(chain.from_iterable(units for _, units in held))
        new = [u for u in met if u not in memory]
        self.characters += sum(map(len, new))
        found = Alignments(pair, new)
        if not found.give_back():
            fine = [u for u in new if pair.given_back(u)]
            memory.update(dict.fromkeys(set(new).difference(fine), -1))
            new, found = fine, Alignments(pair, fine)
        memory.update(zip(new, range(self.given, self.given + len(new))))
        self.given += len(new)
        return found


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for part in slices(batch, "text", 2 << 20):
        yield part, part.column("text").to_pylist()


@lru_cache(maxsize=1)
def remembered(key: tuple) -> dict:
    """What a Python worker keeps from task to task of one pass; the next pass takes its place."""
    return {}


class Ragged:
    """Lists of numbers, laid end to end."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.values, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.lists = self.used = 0

    def append(self, values: list[int], lengths: np.ndarray) -> None:
        if not len(lengths):
            return
        self.values, self.ends = roomier(self.values, self.used + len(values)), roomier(self.ends, self.lists + len(lengths) + 1)
        self.values[self.used : self.used + len(values)] = values
        self.ends[self.lists + 1 : self.lists + 1 + len(lengths)] = self.used + np.cumsum(lengths)
        self.used += len(values)
        self.lists += len(lengths)

    def of(self, lists: np.ndarray) -> np.ndarray:
        """The values of some lists together."""
        starts, lengths = self.ends[lists], self.ends[lists + 1] - self.ends[lists]
        shift = starts - np.cumsum(lengths) + lengths
        return self.values[np.arange(lengths.sum()) + np.repeat(shift, lengths)]


def roomier(array: np.ndarray, needed: int) -> np.ndarray:
    """``array``, or a longer copy that holds ``needed`` rows."""
    if needed <= len(array):
        return array
    longer = np.zeros((max(needed, 2 * len(array)), *array.shape[1:]), array.dtype)
    longer[: len(array)] = array
    return longer


def pair_documents(documents: DataFrame, paths: Tokenizers) -> DataFrame:
    """``task, pair, docs``: per task, each linked pair and the number of the task's documents that hold it."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        kept = remembered((paths, name))
        if not kept:
            # Of pairs, and of each unit its pairs as such numbers.
            kept |= {"aligner": Aligner(paths), "numbers": {}, "pairs": Ragged()}
        aligner, numbers, pairs = kept["aligner"], kept["numbers"], kept["pairs"]
        counts = np.zeros(max(1 << 16, len(numbers)), np.int64)

        def told() -> pa.RecordBatch:
            keys = np.fromiter(numbers, np.int64, len(numbers))  # in the order of their numbers
            docs = counts[: len(keys)]
            some = docs > 0
            columns = [pa.array(np.full(int(some.sum()), task, np.int32)), pa.array(keys[some]), pa.array(docs[some])]
            return pa.RecordBatch.from_arrays(columns, ["task", "pair", "docs"])

        for batch in batches:
            for _, texts in texts_of(batch):
                seen: dict[int, np.ndarray | None] = {}
                for held, emptied in aligner.portions(texts):
                    if emptied:
                        pairs.clear()
                    new = aligner.learn(held)
                    pairs.append([numbers.setdefault(k, len(numbers)) for k in new.links.tolist()], new.n_links)
                    counts = roomier(counts, len(numbers))
                    for row, units in held:
                        told_apart = set(map(aligner.memory.__getitem__, units))
                        if -1 in told_apart or (row in seen and seen[row] is None):
                            seen[row] = None
                            continue
                        linked = pairs.of(np.fromiter(told_apart, np.int64, len(told_apart)))
                        seen[row] = np.unique(np.concatenate([linked, seen[row]]) if row in seen else linked)
                for linked in seen.values():
                    if linked is not None:
                        counts[linked] += 1
                if len(numbers) >= PAIRS_AT_ONCE:
                    yield told()
                    numbers.clear()
                    pairs.clear()
                    aligner.forget()
                    counts[:] = 0
        yield told()

    return in_batches(documents.select(F.col("text").cast("string").alias("text")), run, "task int, pair long, docs long")


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys; other keys get any number, or -1.

    ``sizes`` are the bits of each level and ``ones`` the places of its set bits, in order.
    """

    def __init__(self, sizes: list[int], ones: list[np.ndarray]):
        self.sizes, self.ones = sizes, ones
        self.starts = np.cumsum([0, *map(len, ones)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, ones, left = [], [], keys
        while len(left):
            size = GAMMA * len(left) + 1
            place = cls.places(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            if len(sizes) > 200:
                raise ValueError("keys are not distinct")
            sizes.append(size)
            ones.append(np.flatnonzero(alone).astype(np.int32))
            left = left[~alone[place]]
        return cls(sizes, ones)

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.view(np.uint64), level + 1) % np.uint64(size)).astype(np.int32)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, ones) in enumerate(zip(self.sizes, self.ones)):
            if not len(left):
                break
            place = self.places(keys[left], level, size)
            at = np.searchsorted(ones, place)
            hit = np.append(ones, -1)[at] == place
            out[left[hit]] = self.starts[level] + at[hit]
            left = left[~hit]
        return out

    def bits(self) -> bytes:
        """The levels' bit fields, one after the other."""
        fields = []
        for size, ones in zip(self.sizes, self.ones):
            level = np.zeros(size, bool)
            level[ones] = True
            fields.append(np.packbits(level).tobytes())
        return b"".join(fields)

    @classmethod
    def read(cls, sizes: list[int], raw: bytes) -> PerfectHash:
        ones, at = [], 0
        for size in sizes:
            width = (size + 7) // 8
            ones.append(np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=size)).astype(np.int32))
            at += width
        return cls(list(sizes), ones)


def shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a pair, by the id of the first tokenizer alone."""
    return (mix((pair >> SHIFT).astype(np.uint64), 77) % np.uint64(shards)).astype(np.int64)


HASH_SCHEMA = "shard int, n long, sizes array<int>, bits binary, keys binary"


def with_shard(pairs: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = shard_of(batch.column("pair").to_numpy(), shards).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])

    return pairs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", shard int")


def perfect_hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """One row a shard: its hash and its keys in the order of their numbers."""

    def build(group: pa.Table) -> pa.Table:
        keys = group.column("pair").to_numpy()
        hashed = PerfectHash.of(keys)
        ordered = np.empty_like(keys)
        ordered[hashed.numbers(keys)] = keys
        row = {"shard": group.column("shard")[0].as_py(), "n": len(keys), "sizes": hashed.sizes, "bits": hashed.bits(), "keys": ordered.tobytes()}
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    return with_shard(pairs, shards).groupBy("shard").applyInArrow(build, HASH_SCHEMA)


VECTOR_SCHEMA = "shard int, block int, salt int, counts binary"


def vector_rows(shard: int, salt: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of a dense vector that hold anything, one row each."""
    starts = [at for at in range(0, len(total), BLOCK) if total[at : at + BLOCK].any()]
    numbers = [pa.array([x] * len(starts) if i else [at // BLOCK for at in starts], pa.int32()) for i, x in enumerate((None, shard, salt))]
    cells = pa.array([total[at : at + BLOCK].tobytes() for at in starts], pa.binary())
    yield pa.RecordBatch.from_arrays([numbers[1], numbers[0], numbers[2], cells], ["shard", "block", "salt", "counts"])


def dense_counts(counted: DataFrame, hashes: DataFrame, shards: int) -> DataFrame:
    """``shard, block, counts``: document counts of a shard's pairs in the order of their numbers.

    The counting tasks' rows of a shard are dealt to as many tasks as there are to spare. Each
    reads the shard's hash and then the rows, batch by batch, and leaves a dense vector in blocks;
    the blocks are summed as a tree.
    """
    salts = max(1, shuffle_partitions(counted.sparkSession) // shards)
    rows = with_shard(counted, shards).select(
        "shard", F.pmod("task", F.lit(salts)).cast("int").alias("salt"), "pair", "docs",
        *[F.lit(None).cast(kind).alias(name) for name, kind in (("n", "long"), ("sizes", "array<int>"), ("bits", "binary"), ("keys", "binary"))],
    )
    copies = hashes.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("docs"),
        "n", "sizes", "bits", "keys",
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total, hashed, keys = None, None, None, None
        for batch in batches:
            shard, salt = batch.column("shard").to_numpy(), batch.column("salt").to_numpy()
            heads = np.flatnonzero(batch.column("pair").is_null().to_numpy(zero_copy_only=False))
            for low, high in zip([0, *heads.tolist()], [*heads.tolist(), batch.num_rows]):
                if low < high and (low in heads):
                    if place:
                        yield from vector_rows(*place, total)
                    head = batch.slice(low, 1).to_pylist()[0]
                    place = (head["shard"], head["salt"])
                    hashed, keys = PerfectHash.read(head["sizes"], head["bits"]), np.frombuffer(head["keys"], np.int64)
                    total = np.zeros(head["n"], np.int64)
                    low += 1
                if low < high:
                    if place != (shard[low], salt[low]):
                        raise ValueError("a shard without its hash")
                    asked = batch.column("pair").slice(low, high - low).to_numpy()
                    at = verified(hashed, keys, asked)
                    if (at < 0).any():
                        raise ValueError("a pair that the hash was not built for")
                    np.add.at(total, at, batch.column("docs").slice(low, high - low).to_numpy())
        if place:
            yield from vector_rows(*place, total)

    # Nulls come first, so the hash of a shard stands before its rows.
    dealt = rows.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("pair").asc_nulls_first())
    vectors = in_batches(dealt, count, VECTOR_SCHEMA)

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in group.column("counts").to_pylist())
        first = group.slice(0, 1)
        return first.set_column(first.schema.get_field_index("counts"), "counts", pa.array([total.tobytes()], pa.binary()))

    while salts > 1:
        salts = -(-salts // FAN_IN)
        vectors = vectors.withColumn("salt", F.pmod("salt", F.lit(salts)).cast("int")).groupBy("shard", "block", "salt").applyInArrow(add, VECTOR_SCHEMA)
    return vectors.select("shard", "block", "counts")


def verified(hashed: PerfectHash, keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Numbers of keys, -1 for those that the hash was not built for."""
    at = hashed.numbers(asked)
    return np.where((at >= 0) & (keys[at] == asked), at, -1)


class Portion:
    """Hashes, keys and counts of some shards, as one broadcast value."""

    def __init__(self, shards: int, rows: dict[int, tuple[list[int], bytes, bytes, bytes]]):
        self.shards, self.rows = shards, rows


class Lookup:
    """A portion made ready in a task."""

    def __init__(self, portion: Portion):
        self.shards = portion.shards
        self.tables = {}
        for number, (sizes, bits, keys, counts) in portion.rows.items():
            keys, counts = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
            ids, back = np.unique(keys >> SHIFT, return_inverse=True)
            most = np.zeros(len(ids), np.int64)
            np.maximum.at(most, back, counts)
            self.tables[number] = PerfectHash.read(sizes, bits), keys, counts, counts == most[back]

    def best_and_count(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per pair: whether it is its first id's most frequent one, and its count.

        Zeros in other portions' shards, and for pairs that only texts without tokens hold.
        """
        best, count = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        where = shard_of(pairs, self.shards)
        for number in np.unique(where).tolist():
            if number in self.tables:
                hashed, keys, counts, top = self.tables[number]
                here = np.flatnonzero(where == number)
                at = verified(hashed, keys, pairs[here])
                here, at = here[at >= 0], at[at >= 0]
                best[here], count[here] = top[at], counts[at]
        return best, count


def portions(hashes: DataFrame, counts: DataFrame, shards: int) -> Iterator[Portion]:
    """All shards in portions of at most about ``PORTION_BYTES``; the driver holds one at a time."""
    per_shard = [(r.shard, r.n) for r in hashes.select("shard", "n").orderBy("shard").collect()]  # one row a shard
    groups: list[dict[int, int]] = [{}]
    for shard, n in per_shard:
        if groups[-1] and (sum(groups[-1].values()) + n) * BYTES_PER_PAIR > PORTION_BYTES:
            groups.append({})
        groups[-1][shard] = n
    for group in groups:
        inside = F.col("shard").isin(list(group))
        vectors = {shard: np.zeros(n, np.int64) for shard, n in group.items()}
        for r in counts.where(inside).toLocalIterator():
            cells = np.frombuffer(r.counts, np.int64)
            vectors[r.shard][r.block * BLOCK : r.block * BLOCK + len(cells)] = cells
        held = {r.shard: (list(r.sizes), bytes(r.bits), bytes(r.keys), vectors[r.shard].tobytes()) for r in hashes.where(inside).toLocalIterator()}
        yield Portion(shards, held)


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
RESULT = ("doc_id", *SUMS, "groups_sha256")


def looked_up(documents: DataFrame, paths: Tokenizers, portion: Portion, first: bool) -> DataFrame:
    """Align ``documents(doc_id, text, ...)`` again and add what ``portion`` knows of their links.

    The first portion makes the columns; the others add to ``n_best`` and ``count_sum``.
    """
    shared = documents.sparkSession.sparkContext.broadcast(portion)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = remembered((paths, name))
        if not kept:
            kept |= {"aligner": Aligner(paths), "lookup": Lookup(shared.value), "table": np.zeros((1 << 12, len(SUMS)), np.int64), "groups": []}
        aligner, lookup, table, groups = (kept[k] for k in ("aligner", "lookup", "table", "groups"))
        for batch in batches:
            for part, texts in texts_of(batch):
                sums = np.zeros((len(texts), len(SUMS)), np.int64)
                digests: dict[int, object] = {}  # None for a text that is not given back
                for held, emptied in aligner.portions(texts):
                    if emptied:
                        groups.clear()
                    before = len(groups)
                    new = aligner.learn(held)
                    if len(new):
                        table = kept["table"] = roomier(table, before + len(new))
                        rows = table[before : before + len(new)]
                        best, count = lookup.best_and_count(new.links)
                        starts = np.cumsum(new.n_links) - new.n_links
                        sums_of_links = np.add.reduceat(best, starts), np.add.reduceat(count, starts)
                        for j, column in enumerate((new.n_a, new.n_b, new.n_groups, new.n_links, *sums_of_links)):
                            rows[:, j] = column
                        groups += new.groups()
                    for row, units in held:
                        numbers = list(map(aligner.memory.__getitem__, units))
                        if -1 in numbers or (row in digests and digests[row] is None):
                            digests[row] = None
                            sums[row] = 0
                            continue
                        sums[row] += table[numbers].sum(axis=0)
                        said = ";".join([groups[u] for u in numbers]).encode()
                        if row in digests:
                            digests[row].update(b";" + said)
                        else:
                            digests[row] = hashlib.sha256(said)
                if first:
                    shown = [digests[i].hexdigest() if digests.get(i) else "" for i in range(len(texts))]
                    columns = [*part.columns, *[pa.array(sums[:, j]) for j in range(len(SUMS))], pa.array(shown, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", *RESULT[1:]])
                else:
                    added = {c: pa.array(part.column(c).to_numpy() + sums[:, SUMS.index(c)]) for c in ("n_best", "count_sum")}
                    yield pa.RecordBatch.from_arrays([added.get(c, part.column(c)) for c in part.schema.names], part.schema.names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return in_batches(documents, run, f"doc_id {kind}, text string, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string")


def pair_counts(documents: DataFrame, paths: Tokenizers) -> tuple[DataFrame, DataFrame, int]:
    """The hashes and the dense counts of all pairs of the corpus, and the number of shards."""
    counted = checkpoint(pair_documents(documents, paths))
    distinct = checkpoint(counted.select("pair").distinct())
    shards = max(1, -(-distinct.count() // SHARD_PAIRS))
    hashes = checkpoint(perfect_hashes(distinct, shards))
    return hashes, checkpoint(dense_counts(counted, hashes, shards)), shards


def aligned(documents: DataFrame, paths: Tokenizers) -> DataFrame:
    """Per row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    hashes, counts, shards = pair_counts(rows, paths)
    found = None
    for portion in portions(hashes, counts, shards):
        found = looked_up(rows if found is None else checkpoint(found), paths, portion, found is None)
    return found.select(*RESULT)


def pair_table(documents: DataFrame, paths: Tokenizers) -> DataFrame:
    """``a_id, b_id, docs``: every linked pair and its number of documents, unfolded from the dense vectors."""
    hashes, counts, _ = pair_counts(documents, paths)

    def unfold(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.frombuffer(right.column("keys")[0].as_py(), np.int64)
        total = np.zeros(len(keys), np.int64)
        for block, cells in zip(left.column("block").to_pylist(), left.column("counts").to_pylist()):
            part = np.frombuffer(cells, np.int64)
            total[block * BLOCK : block * BLOCK + len(part)] = part
        return pa.table({"a_id": keys >> SHIFT, "b_id": keys & ((1 << SHIFT) - 1), "docs": total})

    return counts.groupBy("shard").cogroup(hashes.groupBy("shard")).applyInArrow(unfold, "a_id long, b_id long, docs long")
