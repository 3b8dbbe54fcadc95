"""Words of Arrow text columns, cut and hashed on the bytes of whole texts.

A word is a maximal run of characters other than the ASCII blanks ``\\x20\\x09-\\x0D``. The
blanks are single bytes in UTF-8, so words are found on bytes without decoding. A batch is
worked through in slices of a few megabytes, and hashing works in blocks of one megabyte,
so memory stays bounded; only a text that is itself larger makes its slice larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_random = np.random.RandomState(20240229)
LETTER = _random.randint(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ORDER = _random.randint(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    powers = np.full(BLOCK_BYTES + 1, base, dtype=np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        _tables["up"], _tables["down"] = _powers(BASE), _powers(INVERSE)
    return _tables[name]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[starts[i]:ends[i]]``; words are in order and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(ends, low + BLOCK_BYTES, side="right"))
        if j <= i:  # one word longer than a block
            digest = hashlib.blake2b(data[low : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
            i += 1
            continue
        block = data[low : int(ends[j - 1])]
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(LETTER[block] * _table("up")[: len(block)], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * _table("down")[a] + (b - a).astype(np.uint64))
        i = j
    return out


@dataclass
class Words:
    """Words of consecutive texts; word ``i`` is ``data[starts[i]:ends[i]]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_words(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def cut(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> Words:
    """Words of the texts ``data[offsets[k]:offsets[k + 1]]``."""
    offsets = offsets.astype(np.int64) - int(offsets[0])
    solid = ~blank[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] |= solid[inner]
    closes[inner - 1] |= solid[inner - 1]
    starts = np.flatnonzero(opens)
    return Words(data, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, content = column.buffers()
    if where is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if content is None:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    data = np.frombuffer(content, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """At most ``rows`` consecutive rows with about ``size`` bytes of text; a longer text stands alone."""
    _, offsets = text_bytes(batch.column(text))
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(max(high, low + 1), low + rows, batch.num_rows)
        yield batch.slice(low, high - low)
        low = high


def words_of(column: pa.Array) -> Words:
    data, offsets = text_bytes(column)
    return cut(data, offsets)


def runs(words: Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` consecutive words, and the index of their first word.

    Runs stay inside one text; shorter texts have none.
    """
    if len(hashes) < length:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    n = len(hashes) - length + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(length):
        total += hashes[j : j + n] * ORDER[j]
    limit = np.repeat(words.first[1:], words.counts)[:n]
    at = np.flatnonzero(np.arange(n) + length <= limit)
    return mix(total[at], length), at


def longs(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the word sequences ``[starts[i], ends[i])``, which may overlap."""
    n = len(hashes)
    up = np.full(n + 1, BASE, dtype=np.uint64)
    down = np.full(n + 1, INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(hashes, seed) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64), seed)
