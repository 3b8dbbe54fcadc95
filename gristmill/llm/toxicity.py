"""Toxicity by a subsequence string kernel and a support vector machine with Nyström landmarks.

Two strings are alike in so far as they share subsequences of four letters; every letter
skipped inside a subsequence halves its weight, so letters inserted into an insult cost something
but do not hide it. Signs are no letters: dots, stars or blanks between the letters cost nothing.
The kernel is divided by what a string of that length can have at most.

The instances are the words of a sentence, and runs of single letters. A machine is trained on
sentences of labelled documents: each is represented by its most suspicious word, and one of a
toxic document counts as an example only with enough evidence (a likelihood ratio); suspicion is
that evidence first and then the value of the machine itself, for a few rounds. Suspicious words
are trained on in disguise too (letters inserted, letters replaced). A document is scored by its
highest value and by how many of its instances, and how large a share, are above 0, blended by a
logistic regression; the decision with the best F1 on the training documents lies at 0.3.

The model is fitted on a bounded sample of labelled documents (``per_class`` of each class and at
most ``longest`` characters each, chosen by hash). With the landmarks given, the machine is one
weight per subsequence, a table of 4 MB that is broadcast; scoring reads every whole text once.

Defined cases: null and empty texts have the lowest score; a null id is scored and belongs to
no fold; repeated rows are scored alike; without both classes among the labels all scores are 0;
extra columns are ignored. Labels that are null, or repeated, count once, toxic if any row says so.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gristmill.llm.tables import in_batches
from gristmill.llm.words import Words, cut, slices, text_bytes

ORDER, SPAN, DECAY = 4, 6, 0.5
LETTERS = 32  # a to z, other letters and digits, the start of a word, four classes of accented letters
SKIPS = [(0, *c) for c in combinations(range(1, SPAN + 1), ORDER - 1)]
LONG, STRIDE = 32, 16
THRESHOLD = 0.3
EVIDENCE = 20.0  # log-likelihood ratio at which a word of toxic documents is taken for an insult

OTHER, START, ACCENT = 26, 27, 28
CODE = np.full(256, 255, dtype=np.uint8)
CODE[ord("a") : ord("z") + 1] = np.arange(26)
CODE[ord("A") : ord("Z") + 1] = np.arange(26)
CODE[ord("0") : ord("9") + 1] = OTHER
CODE[0xC4:] = OTHER  # first bytes of characters; their further bytes are no letters
CODE[1] = START  # set before each word
LATIN = 0xC3  # the byte before accented Latin letters, which fall into four classes


def subsequences(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern of skips: places, subsequence numbers, weight. Owners ascend."""
    wide = codes.astype(np.int64)
    for skip in SKIPS:
        n = len(codes) - skip[-1]
        if n <= 0:
            continue
        at = np.flatnonzero(owner[:n] == owner[skip[-1] :])
        number = wide[at]
        for s in skip[1:]:
            number = number * LETTERS + wide[at + s]
        yield at, number, DECAY ** (skip[-1] - ORDER + 1)


def most(length: int) -> float:
    """The kernel of a string of that length with itself if no subsequence repeats."""
    total = 0.0
    for skip in SKIPS:
        total += max(0, length - skip[-1]) * DECAY ** (2 * (skip[-1] - ORDER + 1))
    return total


SCALE = np.array([1.0 / math.sqrt(most(n)) if most(n) > 0 else 0.0 for n in range(LONG + 2)])


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of the words in a row, each after a start mark, their owners and numbers."""
    data = np.frombuffer(b"".join(b"\x01" + w for w in words), dtype=np.uint8)
    codes = CODE[data]
    accented = np.flatnonzero(data[:-1] == LATIN) + 1
    codes[accented] = ACCENT + data[accented] % 4
    owner = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
    good = codes != 255
    owner = owner[good]
    return codes[good], owner, np.bincount(owner, minlength=len(words))


def instances(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the instances: words, windows of long words, runs of single letters."""
    owner, size = words.owner(), words.ends - words.starts
    pieces = np.maximum(1, -(-(size - LONG) // STRIDE) + 1)
    pieces[size <= LONG] = 1
    which = np.repeat(np.arange(len(size)), pieces)
    step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = words.starts[which] + step * STRIDE
    end = np.where(pieces[which] == 1, words.ends[which], np.minimum(start + LONG, words.ends[which]))
    text = owner[which]
    single = np.flatnonzero(size == 1)
    if len(single) > ORDER - 1:
        new = np.flatnonzero(np.r_[True, (np.diff(single) > 1) | (np.diff(owner[single]) > 0)])
        stop = np.r_[new[1:], len(single)]
        for a, b in zip(new, stop):
            for i in range(a, max(a + 1, b - ORDER + 1), STRIDE // 2):
                j = min(i + STRIDE, b)
                if j - i >= ORDER:
                    text = np.r_[text, owner[single[i]]]
                    start, end = np.r_[start, words.starts[single[i]]], np.r_[end, words.ends[single[j - 1]]]
    return text, start, end


@dataclass
class Model:
    weights: np.ndarray  # one per subsequence
    bias: float
    blend: np.ndarray  # weights of a document's features, the constant last
    middle: float  # the blended value that gets the score 0.3

    def values(self, words: list[bytes]) -> np.ndarray:
        codes, owner, n = letters(words)
        total = np.zeros(len(words))
        for at, number, weight in subsequences(codes, owner):
            total += weight * np.bincount(owner[at], weights=self.weights[number], minlength=len(words))
        return total * SCALE[np.minimum(n, len(SCALE) - 1)] + self.bias

    def scores(self, found: np.ndarray) -> np.ndarray:
        z = found @ self.blend - self.middle + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of the whole texts of a slice; each different instance is valued once."""
        text, start, end = instances(cut(data, offsets))
        raw = data.tobytes()
        distinct: dict[bytes, int] = {}
        back = np.fromiter(
            (distinct.setdefault(raw[a:b], len(distinct)) for a, b in zip(start.tolist(), end.tolist())),
            dtype=np.int64, count=len(text),
        )
        value = self.values(list(distinct))[back] if len(text) else np.zeros(0)
        return self.scores(features(text, value, len(offsets) - 1))


def features(text: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """Per text: its highest value, how many instances are above 0, how large a share, and 1."""
    best = np.full(texts, -1.0)
    np.maximum.at(best, text, np.clip(value, -1.0, 3.0))
    above = np.bincount(text, weights=np.clip(value, 0, 1), minlength=texts)
    n = np.bincount(text, minlength=texts)
    return np.c_[best, np.log1p(above), np.log1p(100 * above / np.maximum(n, 1)), np.ones(texts)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps; the last column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(penalty + (x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Kernel of words (rows) with landmarks (columns)."""
    codes, owner, n = letters(landmarks)
    found = [(owner[at], number, np.full(len(at), weight)) for at, number, weight in subsequences(codes, owner)]
    where, numbers, weights = (np.concatenate(x) for x in zip(*found))
    columns, place = np.unique(numbers, return_inverse=True)
    table = np.zeros((len(columns), len(landmarks)))
    np.add.at(table, (place, where), weights * SCALE[np.minimum(n, len(SCALE) - 1)][where])
    out = np.zeros((len(words), len(landmarks)))
    for low in range(0, len(words), 500):
        codes, owner, n = letters(words[low : low + 500])
        for at, number, weight in subsequences(codes, owner):
            column = np.minimum(np.searchsorted(columns, number), len(columns) - 1)
            hit = columns[column] == number
            np.add.at(out, low + owner[at[hit]], weight * table[column[hit]])
        out[low : low + 500] *= SCALE[np.minimum(n, len(SCALE) - 1)][:, None]
    return out


def support_vectors(x: np.ndarray, y: np.ndarray, importance: np.ndarray, strength: float = 2.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by repeated least squares on the violators."""
    x = np.c_[x, np.ones(len(x))]
    penalty = np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(40):
        active = y * (x @ w) < 1
        weighted = x[active] * (strength * importance[active])[:, None]
        new = np.linalg.solve(penalty + weighted.T @ x[active], weighted.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def disguises(word: bytes, rng: np.random.RandomState) -> list[bytes]:
    """The word with one or two letters inserted, and with one letter replaced by a digit."""
    out = []
    for inserts in (1, 1, 2):
        made = word
        for _ in range(inserts):
            at = rng.randint(1, len(made))
            made = made[:at] + bytes([97 + rng.randint(26)]) + made[at:]
        out.append(made)
    if len(word) > ORDER:
        at = rng.randint(1, len(word) - 1)
        out.append(word[:at] + b"1" + word[at + 1 :])
    return out


def bare(word: bytes) -> bytes:
    """Letters and digits of a word in lower case."""
    return bytes(b for b in word.lower() if b >= 0x80 or (CODE[b] != 255 and b > 1))


def split_sentences(text: str) -> list[list[bytes]]:
    """Instances of each sentence of a text."""
    out, sentence = [], []
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    words = cut(raw, np.array([0, len(raw)]))
    _, start, end = instances(words)
    data = raw.tobytes()
    for a, b in zip(start.tolist(), end.tolist()):
        word = data[a:b]
        sentence.append(bare(word))
        if word.endswith((b".", b"!", b"?")):
            out.append(sentence)
            sentence = []
    return [*out, sentence] if sentence else out


def fit(sample: list[tuple[str, int]], landmarks: int = 400, rounds: int = 3, seed: int = 7) -> Model:
    """The model from ``(text, toxic)`` of labelled documents.

    The blend and the decision are fitted on values that each half of the documents gets from a
    machine trained on the other half, so they do not rely on words learned by heart.
    """
    documents = [(split_sentences(t), y) for t, y in sample if t]
    halves = [documents[0::2], documents[1::2]]
    machine = train(documents, landmarks, rounds, seed)
    if machine is None:
        return Model(np.zeros(LETTERS**ORDER, dtype=np.float32), 0.0, np.zeros(4), 1e9)
    found, truth = [], []
    for own, other in (halves, halves[::-1]):
        half = train(other, landmarks, rounds, seed) or machine
        found.append(features(*valued(half, own), len(own)))
        truth += [y for _, y in own]
    x, y = np.concatenate(found), np.array(truth)
    machine.blend = logistic(x, y)
    machine.middle = threshold(x @ machine.blend, y)
    return machine


def valued(model: Model, documents: list) -> tuple[np.ndarray, np.ndarray]:
    """Document and value of all instances."""
    place: dict[bytes, int] = {}
    where = [[place.setdefault(w, len(place)) for s in d for w in s] for d, _ in documents]
    words = list(place)
    value = [model.values(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
    flat = np.array([i for d in where for i in d], dtype=int)
    return np.repeat(np.arange(len(where)), [len(d) for d in where]), np.concatenate([*value, np.zeros(0)])[flat]


def train(documents: list, landmarks: int, rounds: int, seed: int) -> Model | None:
    """The machine: one weight per subsequence. None without words of both classes."""
    sides = Counter(y for _, y in documents)
    if not sides[0] or not sides[1]:
        return None
    rng = np.random.RandomState(seed)
    seen = {0: Counter(), 1: Counter()}
    for sentences, y in documents:
        seen[y].update({w for s in sentences for w in s if len(w) >= ORDER})
    words = sorted(seen[0].keys() | seen[1].keys())
    if not words:
        return None
    place = {w: i for i, w in enumerate(words)}
    toxic = np.array([seen[1][w] for w in words], dtype=float)
    clean = np.array([seen[0][w] for w in words], dtype=float)
    rate = toxic / sides[1] - clean / sides[0]
    evidence = association(toxic, clean, sides)
    enough = min(EVIDENCE, evidence.max() / 2)
    chosen = np.argsort(-rate, kind="stable")[: landmarks // 2].tolist()
    common = [i for i in np.argsort(-clean, kind="stable").tolist() if i not in set(chosen)][: landmarks // 2]
    marks = [words[i] for i in chosen + common]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    kept = values > 1e-3 * values.max()
    project = vectors[:, kept] / np.sqrt(values[kept])
    numbered = [([np.array([place[w] for w in s if w in place], dtype=int) for s in d], y) for d, y in documents]
    # Every document's most suspicious word of each sentence; in toxic ones those with enough evidence.
    value, suspicious = evidence, evidence >= enough
    for _ in range(rounds):
        top, negatives = set(), set()
        for sentences, y in numbered:
            found = {int(s[np.argmax(value[s])]) for s in sentences if len(s)}
            if y:
                top |= {i for i in found if suspicious[i]}
            else:
                negatives |= found
        negatives -= top
        hard = sorted(negatives, key=lambda i: (-value[i], i))[:4000]
        some = rng.permutation(sorted(negatives))[:4000].tolist()
        positive = [(words[i], 1.0) for i in sorted(top)]
        positive += [(d, 0.5) for w, _ in positive[:] for d in disguises(w, rng)]
        negative = sorted({*hard, *some})
        x = kernel([w for w, _ in positive] + [words[i] for i in negative], marks) @ project
        y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        importance = np.r_[[n for _, n in positive], [1.0] * len(negative)].astype(float)
        importance[y > 0] *= len(negative) / max(importance[y > 0].sum(), 1e-9)
        w, bias = support_vectors(x, y, importance)
        model = Model(table(marks, project @ w), bias, np.zeros(4), 0.0)
        value = np.concatenate([model.values(words[i : i + 20_000]) for i in range(0, len(words), 20_000)])
        suspicious = (evidence >= enough) | ((value > 0) & (evidence >= enough / 4))
    return model


def association(toxic: np.ndarray, clean: np.ndarray, sides: Counter) -> np.ndarray:
    """Log-likelihood ratio of a word occurring more often in toxic documents, else 0."""
    share = sides[1] / (sides[0] + sides[1])
    expected = np.maximum((toxic + clean) * share, 1e-9)
    rest = np.maximum((toxic + clean) * (1 - share), 1e-9)
    ratio = toxic * np.log(np.maximum(toxic, 1e-9) / expected) + clean * np.log(np.maximum(clean, 1e-9) / rest)
    return np.where(toxic > expected, 2 * ratio, 0.0)


def table(marks: list[bytes], beta: np.ndarray) -> np.ndarray:
    """One weight per subsequence: the machine written out over its landmarks."""
    codes, owner, n = letters(marks)
    scaled = beta * SCALE[np.minimum(n, len(SCALE) - 1)]
    out = np.zeros(LETTERS**ORDER)
    for at, number, weight in subsequences(codes, owner):
        np.add.at(out, number, weight * scaled[owner[at]])
    return out.astype(np.float32)


def threshold(value: np.ndarray, truth: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap it falls into."""
    order = np.argsort(-value, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + truth.sum())
    last = np.r_[value[order][1:] < value[order][:-1], True]
    k = int(np.argmax(np.where(last, f1, -1)))
    below = value[order][k + 1] if k + 1 < len(order) else value[order][k] - 1
    return float((value[order][k] + below) / 2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(documents: DataFrame, labels: DataFrame, per_class: int, longest: int) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled documents of each class outside the held-out fold, by hash."""
    rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = rows.where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = [rows.where(F.col("toxic") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(few[0].unionByName(few[1]))  # twice per_class rows of two numbers
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= longest)
    found = texts.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    return [(r.text, int(r.toxic)) for r in found.orderBy("doc_id").collect()]


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = shared.value.texts(*text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    chosen = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    scored = in_batches(chosen, run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def toxicity(documents: DataFrame, labels: DataFrame, per_class: int = 2_000, longest: int = 100_000) -> DataFrame:
    return score(documents, fit(training_sample(documents, labels, per_class, longest)))
