"""Target-distribution importance resampling on hashed word runs.

A 256-byte table lower-cases ``A-Z`` and blanks every ASCII separator in the UTF-8 bytes of a
text; ``bytes.split`` then yields the words, and a run of words is hashed by chaining
``zlib.crc32``: the checksum of a run is the seed for the run that is one word longer. Counters
reduce the runs of a slice of texts, a task adds its slices into one vector of buckets, and only
that vector leaves it. The corpus and the target are counted over all their texts; what comes
to the driver and goes back as a broadcast is one number a bucket, whatever the data.

A document's weight is the sum of the gains of its runs' buckets. Scores add Gumbel noise that
is a function of the id, so drawing the highest scores draws without replacement in proportion
to the weights. The draw numbers rows along key ranges, never in one task.

Defined cases: a null or empty text has no words; a null id hashes like an empty one and comes
last among equal scores; repeated rows are documents of their own with equal scores and
following ranks; an empty target leaves only what the corpus says, an empty corpus gives an
empty result; a text of any length is read in pieces; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gristmill.llm.tables import in_batches
from gristmill.llm.words import slices, text_bytes
from gristmill.plans.ordering import with_row_number
from gristmill.plans.session import checkpoint

BUCKETS = 10_000
LONGEST_RUN = 3
PIECE_BYTES = 1 << 20
SEED = 42


def separators() -> bytes:
    """The translation table: letters A-Z to lower case, all other ASCII but a-z and 0-9 to blanks."""
    table = bytearray(range(256))
    for byte in range(128):
        letter = chr(byte).lower()
        table[byte] = ord(letter) if letter.isalnum() else 0x20
    return bytes(table)


TABLE = separators()


def pieces(raw: bytes) -> Iterator[bytes]:
    """A translated text in pieces of about a megabyte that end between words."""
    low = 0
    while len(raw) - low > PIECE_BYTES:
        high = raw.find(b" ", low + PIECE_BYTES)
        if high < 0:
            break
        yield raw[low:high]
        low = high
    yield raw[low:]


def run_hashes(raw: bytes, longest: int = LONGEST_RUN) -> Iterator[tuple[int, list[int]]]:
    """Checksums of all runs of 1 to ``longest`` words of one text: pairs of run length and checksums."""
    before: list[bytes] = []  # the last words of the piece before, whose longer runs are still open
    for piece in pieces(raw.translate(TABLE)):
        words = before + piece.split()
        follows = [b" " + word for word in words]
        sums = list(map(crc32, words))
        yield 1, sums[len(before) :]
        for length in range(2, longest + 1):
            sums = list(map(crc32, islice(follows, length - 1, None), sums))
            # Runs that end inside ``before`` were counted with the piece they ended in.
            yield length, sums[max(0, len(before) - length + 1) :]
        before = words[max(0, len(words) - longest + 1) :]


def folded(counter: Counter, buckets: int) -> np.ndarray:
    """Counts per bucket of counted checksums."""
    n = len(counter)
    sums = np.fromiter(counter.keys(), np.int64, n)
    return np.bincount(sums % buckets, weights=np.fromiter(counter.values(), np.int64, n), minlength=buckets).astype(np.int64)


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """``bucket, n``: runs of all whole texts per bucket, absent where none falls."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                counter: Counter = Counter()
                for raw in raw_texts(part.column("text")):
                    for _, sums in run_hashes(raw, longest):
                        counter.update(sums)
                if counter:
                    total += folded(counter, buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    counted = in_batches(texts.select(F.col(f"`{column}`").cast("string").alias("text")), count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = text_bytes(column)
    raw = data.tobytes()
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield raw[low:high]


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths: the log ratio of its smoothed shares, rounded down."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    s, t = [0] * buckets, [0] * buckets
    for row in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # one row a bucket
        s[row.bucket], t[row.bucket] = row.s, row.t
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)], dtype=np.int64)


def weigh(documents: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """Per row: ``doc_id, n_words, n_features, weight``. ``gain`` is broadcast, one number a bucket."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.zeros((part.num_rows, 3), dtype=np.int64)
                for i, raw in enumerate(raw_texts(part.column("text"))):
                    for length, sums in run_hashes(raw, longest):
                        n = len(sums)
                        found[i, 0] += n if length == 1 else 0
                        found[i, 1] += n
                        found[i, 2] += gain[np.fromiter(sums, np.int64, n) % len(gain)].sum()
                columns = [part.column("doc_id"), *[pa.array(found[:, j]) for j in range(3)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    chosen = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return in_batches(chosen, run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(id_column: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resampled(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = SEED) -> DataFrame:
    """Per row: ``doc_id, n_features, weight, score, rank``; rank is null where the row is not drawn.

    ``percent`` of the documents with at least ``least_words`` words are drawn.
    """
    gain = gains(bucket_counts(documents), bucket_counts(target))
    scored = checkpoint(weigh(documents, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    long_enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(long_enough).count() // 100
    keyed = scored.where(long_enough).select("*", (-F.col("score")).alias("lower"), F.col("doc_id").isNull().alias("nameless"))
    placed = with_row_number(keyed, ["lower", "nameless", "doc_id", "weight", "n_features"], "place")
    rank = F.when(F.col("place") < drawn, (F.col("place") + 1).cast("long"))
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    shown = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.withColumn("rank", rank).select(*shown).unionByName(rest.select(*shown))


def drawn_documents(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``documents`` with all their columns.

    Rows are drawn by id: of rows that share an id all are returned if one is drawn. Rows with
    a null id are drawn together likewise.
    """
    chosen = resampled(documents, target, percent, least_words, seed).where("rank IS NOT NULL").select(F.col("doc_id").alias("chosen_id")).distinct()
    return documents.join(chosen, documents["doc_id"].eqNullSafe(chosen["chosen_id"]), "left_semi")
