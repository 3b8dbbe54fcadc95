import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from gristmill.llm.toxicity import DECAY, ORDER, SPAN, fit, kernel, most, toxicity
from gristmill.llm.words import text_bytes

SF = "/root/testdata/sf0.01"


def plain(a, b):
    """The kernel by enumerating all subsequences; a start mark stands before each word."""
    from collections import Counter
    from itertools import combinations

    def table(word):
        out, letters = Counter(), "^" + word
        for at in combinations(range(len(letters)), ORDER):
            if at[-1] - at[0] <= SPAN:
                out[tuple(letters[i] for i in at)] += DECAY ** (at[-1] - at[0] - ORDER + 1)
        return out

    x, y = table(a), table(b)
    scale = (most(len(a) + 1) * most(len(b) + 1)) ** 0.5
    return sum(n * y[u] for u, n in x.items()) / scale if scale else 0.0


def test_kernel_is_the_subsequence_kernel():
    words = ["idiot", "idxiot", "iddiot", "thing", "abc", "moronmoron", "onomatopoeia"]
    raw = [w.encode() for w in words]
    got = kernel(raw, raw)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(got[i, j] - plain(a, b)) < 1e-9
    assert got[0, 1] > 0.3 > got[0, 3]


def test_gaps_and_insertions_are_tolerated():
    rng = np.random.RandomState(0)
    syllables = ["an", "er", "th", "ing", "on", "re", "ti", "sh", "le", "ou", "st", "en"]
    say = lambda n: " ".join("".join(rng.choice(syllables, rng.randint(1, 4))) for _ in range(n))
    sample = [(say(60) + " idiot. " + say(20) + " you pathetic " + say(10), 1) for _ in range(60)] + [(say(90), 0) for _ in range(120)]
    model = fit(sample, landmarks=64)
    texts = [say(40) + f" {w} {w} " + say(20) for w in ("idiot", "i.d.i.o.t", "idxiot", "i d i o t", "pathhetic", "pat-hetic")] + [say(60) for _ in range(30)] + ["", None]
    scores = model.texts(*text_bytes(pa.array(texts, pa.string())))
    assert (scores[:6] >= 0.3).all() and (scores[6:] < 0.3).mean() > 0.9
    assert scores[-1] == scores[-2] == min(scores) or scores[-1] < 0.3
    assert ((scores >= 0) & (scores <= 1)).all()


def test_held_out_documents_are_told_apart(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in toxicity(documents, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    truth = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    held = [(truth[i], got[i].score) for i in truth if got[i].held_out]
    toxic, clean = [s for y, s in held if y], [s for y, s in held if not y]
    ranked = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert ranked > 0.8


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (3, "z" * 100_000, "d"), (3, "z" * 100_000, "d")], "doc_id long, text string, SCORE string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity(df, labels).collect()
    assert len(got) == 5 and all(r.predicted == 0 and 0 <= r.score < 0.3 for r in got)
    assert toxicity(df.limit(0), labels.limit(0)).collect() == []
