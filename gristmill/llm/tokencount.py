"""Token counts by count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates all vocabulary pieces that end at each character; dynamic programming
carries the best score and the number of pieces up to there, and nothing else, so no token is
ever made. Rules are those of the unigram tokenizers: a space is written ``▁`` and one is put
before the text; of equal scores the piece that starts earliest wins; a character without a
piece of its own costs ten less than the worst piece and counts as its UTF-8 bytes where the
vocabulary has byte pieces, else a run of such characters counts as one.

No piece has ``▁`` after its first other character, so the best path of a text is the best paths of
its words put together, where words end at blanks that no piece contains. Words repeat, so each
distinct word of a slice is solved once, and the first words met are remembered, up to a bound.
If a vocabulary or a text breaks that rule, the whole text is solved in one go.

Defined cases: null and empty texts have no tokens; a null id is kept; repeated rows are counted
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gristmill.llm.tables import in_batches
from gristmill.llm.words import BLANK, cut, mix, slices, text_bytes

MARK = "▁"
MARK_BYTES = MARK.encode()
REMEMBERED = 300_000
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    pieces: list[tuple[str, float]]
    bytes_for_unknown: bool


def read_vocabulary(path: str) -> Vocabulary:
    """Ordinary pieces and scores of a sentencepiece file, read as unigram scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    every = range(model.get_piece_size())
    return Vocabulary(
        [(model.id_to_piece(i), model.get_score(i)) for i in every if not special(i)],
        any(model.is_byte(i) for i in every),
    )


class Counter:
    """Counts pieces of strings; built once per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes_for_unknown = vocabulary.bytes_for_unknown
        self.cuttable = not any(MARK in p.lstrip(MARK) for p, _ in vocabulary.pieces)
        # Blanks that stand inside pieces (line ends, say) do not part words.
        self.blank = BLANK.copy()
        self.blank[[ord(b) for b in "\t\n\x0b\x0c\r" if any(b in p for p, _ in vocabulary.pieces)]] = False
        # Without byte pieces unknown characters of neighbouring words would count together.
        self.cuttable = self.cuttable and self.bytes_for_unknown
        self.memory: dict[int, tuple[int, float]] = {}

    def solve(self, text: str) -> tuple[int, float]:
        """Number of pieces and score of the best path over ``text``, as written with marks."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        unknown = self.unknown
        run = -1  # where the last run of unknown characters ended
        done = 0  # characters settled
        top: float | None = None
        pieces, single = 0, False
        matches = self.machine.iter(text)
        for last, piece in chain(matches, ((n, None),)):
            while done < last:  # all pieces that end with the next character are known
                if not single:
                    value = best[done] + unknown
                    if top is None or value > top:
                        top = value
                        if self.bytes_for_unknown:
                            pieces = count[done] + len(text[done].encode())
                        else:
                            pieces = count[done] + (run != done)
                            run = done + 1
                done += 1
                best[done], count[done] = top, pieces
                top, single = None, False
            if piece is None:
                break
            length, score = piece
            start = last + 1 - length
            value = best[start] + score
            if top is None or value > top:  # longer pieces come first, so ties keep the earlier start
                top, pieces = value, count[start] + 1
            if length == 1:
                single = True
        return count[n], best[n]

    def whole(self, text: str) -> tuple[int, float]:
        return self.solve(MARK + text.replace(" ", MARK)) if text else (0, 0.0)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and scores of the texts of a slice."""
        n = len(offsets) - 1
        raw = data.tobytes()
        if not self.cuttable:
            solved = [self.whole(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.array([c for c, _ in solved], dtype=np.int64), np.array([s for _, s in solved])
        whole = np.zeros(n, dtype=bool)
        at = raw.find(MARK_BYTES)
        while at >= 0:  # a mark in a text could join its words
            text = int(np.searchsorted(offsets, at, side="right")) - 1
            whole[text] = True
            at = raw.find(MARK_BYTES, int(offsets[text + 1]))
        words = cut(data, offsets, self.blank)
        counts, scores = np.zeros(n, dtype=np.int64), np.zeros(n)
        owner = words.owner()
        if len(owner):
            before = np.r_[0, words.ends[:-1]]
            first = words.first[:-1][words.counts > 0]
            before[first] = offsets[:-1][words.counts > 0]
            gap = words.starts - before
            opening = np.zeros(len(owner), dtype=bool)
            opening[first] = True
            plain = (gap == 1) & ~opening
            marks = np.where(opening & (gap == 0), 1, np.where(plain & (data[words.starts - 1] == 0x20), 1, 0))
            line = plain & (data[words.starts - 1] != 0x20)
            if line.any():  # one blank other than a space: one unknown character
                np.add.at(counts, owner[line], 1)
                np.add.at(scores, owner[line], self.unknown)
            for i in np.flatnonzero(~plain & ~(opening & (gap == 0))):
                blank = raw[before[i] : words.starts[i]].decode()
                marks[i] = self.gap(blank, bool(opening[i]), int(owner[i]), counts, scores)
            key = mix(words.hashes() + marks.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25), 5)
            unique, where, back = np.unique(key, return_index=True, return_inverse=True)
            solved = np.empty((len(unique), 2))
            for j, k in enumerate(unique.tolist()):
                known = self.memory.get(k)
                if known is None:
                    i = where[j]
                    known = self.solve(MARK * int(marks[i]) + raw[words.starts[i] : words.ends[i]].decode())
                    if len(self.memory) < REMEMBERED:
                        self.memory[k] = known
                solved[j] = known
            counts += np.bincount(owner, weights=solved[back, 0], minlength=n).astype(np.int64)
            scores += np.bincount(owner, weights=solved[back, 1], minlength=n)
        last = np.where(words.counts > 0, np.r_[words.ends, 0][np.maximum(words.first[1:] - 1, 0)], offsets[:-1])
        for i in np.flatnonzero(last < offsets[1:]):
            blank = raw[last[i] : offsets[i + 1]].decode()
            rest = self.gap(blank, words.counts[i] == 0, int(i), counts, scores)
            if rest:
                pieces, score = self.solve(MARK * rest)
                counts[i] += pieces
                scores[i] += score
        for i in np.flatnonzero(whole):
            counts[i], scores[i] = self.whole(raw[offsets[i] : offsets[i + 1]].decode())
        return counts, scores

    def gap(self, blank: str, opening: bool, text: int, counts: np.ndarray, scores: np.ndarray) -> int:
        """Count blanks up to the last run of spaces, whose marks belong to what follows."""
        marked = (MARK if opening else "") + blank.replace(" ", MARK)
        body = marked.rstrip(MARK)
        if body:
            pieces, score = self.solve(body)
            counts[text] += pieces
            scores[text] += score
        return len(marked) - len(body)


def token_counts(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row: ``doc_id, n_tokens, best_score``. The vocabulary is broadcast (tens of thousands of pieces)."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                counts, scores = counter.texts(*text_bytes(part.column("text")))
                columns = [part.column("doc_id"), pa.array(counts), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "best_score"])

    chosen = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return in_batches(chosen, run, f"doc_id {kind}, n_tokens long, best_score double")
