import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gristmill.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(rows, target, percent=5):
    s = Counter(bucket(f) for _, text in rows for f in features(text)[1])
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    found = []
    for doc_id, text in rows:
        words, grams = features(text)
        weight = sum(gain(bucket(f)) for f in grams)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([doc_id, len(words), len(grams), weight, score])
    able = sorted((r for r in found if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted([(r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in found], key=repr)


def got(spark, rows, target, **kwargs):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    return sorted([tuple(r) for r in resampling.resampled(docs, items, **kwargs).collect()], key=repr)


def story(n, start=0):
    return " ".join(f"Word{(start * 7 + i * i) % 97}" for i in range(n))


ROWS = [(i, story(15 + i % 40, i)) for i in range(60)] + [
    (100, None), (101, ""), (102, " \t\n.-"), (103, "Été È naïve ÀB ça va  z 中文,字 A1b2" * 5), (None, story(30, 3)), (None, story(30, 3)),
    (7, story(30, 9)), (7, story(30, 9)), (104, "x" * 50_000), (105, story(22) + "\x00\x7f" + story(3)),
]


def test_as_brute_force(spark):
    target = [story(40, 2), "Été È naïve", None, ""]
    assert got(spark, ROWS, target) == plain(ROWS, target)
    assert got(spark, ROWS, target, percent=100) == plain(ROWS, target, 100)


def test_empty_tables(spark):
    assert got(spark, ROWS, []) == plain(ROWS, [])
    assert got(spark, [], [story(30)]) == []
    short = [(1, "a few words"), (2, None)]
    assert got(spark, short, [story(30)]) == plain(short, [story(30)])


@pytest.mark.parametrize("size", [1, 7, 40])
def test_pieces_of_a_long_text_give_the_same_runs(monkeypatch, size):
    text = (story(200) + " ÉÉ  .. a " + "z" * 90 + " " + story(50, 4)).encode()
    whole = Counter(s for _, sums in resampling.run_hashes(text) for s in sums)
    monkeypatch.setattr(resampling, "PIECE_BYTES", size)
    assert Counter(s for _, sums in resampling.run_hashes(text) for s in sums) == whole
    assert whole == Counter(zlib.crc32(f.encode()) for f in features(text.decode())[1])


def test_a_very_long_text(spark):
    rows = [(1, story(400_000)), (2, story(25))]
    target = [story(30, 5)]
    assert got(spark, rows, target, percent=50) == plain(rows, target, 50)


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("Weight", F.lit(1))
    items = spark.createDataFrame([(0, story(40, 2))], "item_id long, text string")
    drawn = resampling.drawn_documents(docs, items, percent=20)
    assert drawn.columns == docs.columns
    want = {r.doc_id for r in resampling.resampled(docs, items, percent=20).where("rank IS NOT NULL").collect()}
    assert {r.doc_id for r in drawn.collect()} == want and want


def test_target_like_documents_are_drawn_first(spark):
    like = [(i, " ".join(f"goal{(i + j) % 30}" for j in range(60))) for i in range(10)]
    other = [(100 + i, " ".join(f"noise{(i * 3 + j) % 40}" for j in range(60))) for i in range(90)]
    ranks = got(spark, like + other, [" ".join(f"goal{j}" for j in range(30))] * 3, percent=10)
    assert {r[0] for r in ranks if r[4]} == set(range(10))
