import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm import alignment
from gristmill.llm.alignment import PerfectHash, Tokenizers, aligned, byte_letters, pair_table

PATHS = Tokenizers("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")


class Plain:
    """Whole texts through both tokenizers, links by comparing all ranges."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATHS.byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS.pieces)
        self.letters = byte_letters()

    def of(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        left = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a]
        pieces = [self.b.id_to_piece(i) for i in b]
        right = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        raw = (" " + text).encode()
        if b"".join(left) != raw or b"".join(right) != raw:
            return None
        a_ends, b_ends = np.cumsum([len(x) for x in left]).tolist(), np.cumsum([len(x) for x in right]).tolist()
        ranges = lambda ends: list(zip([0, *ends], ends))
        links = [(x, y) for x, (s, e) in zip(a, ranges(a_ends)) for y, (t, f) in zip(b, ranges(b_ends)) if s < f and t < e]
        both = sorted(set(a_ends) & set(b_ends))
        groups = []
        for low, high in zip([0, *both], both):
            inside = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends) if low < e <= high)
            groups.append(inside(a, a_ends) + "|" + inside(b, b_ends))
        return a, b, links, groups

    def all(self, rows):
        found = [(i, self.of(t)) for i, t in rows]
        count = Counter(link for _, f in found if f for link in set(f[2]))
        most = Counter()
        for (a, _), n in count.items():
            most[a] = max(most[a], n)
        out = []
        for i, f in found:
            if f is None:
                out.append((i, 0, 0, 0, 0, 0, 0, ""))
                continue
            a, b, links, groups = f
            best = sum(count[x] == most[x[0]] for x in links)
            out.append((i, len(a), len(b), len(groups), len(links), best, sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        return sorted(out, key=repr), {(*k, n) for k, n in count.items()}


@pytest.fixture(scope="module")
def plain():
    return Plain()


TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "Hello, world", "  leading and  double   blanks ", "tail ", " ", "   ", "\n", "a\n b\n\n c \n", "tab\tinside \t blanks\t",
    "it's we're 'tis can't 's 'S", "naïve café ÀÉÎ über straße", "中文 字符 混在 text 里", "emoji \U0001f600\U0001f468‍\U0001f469 end", "▁ mark", "x▁y", "a  b  c  d", "　 x  y z",
    "<|endoftext|> <s> </s> <unk> <0x0A>", "null\x00byte \x1c \x1f x\x1c y", "é combining ́ alone", "12345 67.89 1,000", "word" * 400, "zero​width ﻿bom", "\r\nline\r\n two;\r {\r", None, "", "x",
    "!!! ??? ... --- ", "a  ", "\t", "\u0085next \u0085 line", "CamelCaseWords andMore_snake_case http://x.y/z?q=1",
]
ROWS = list(enumerate(TEXTS)) + [(1, "Hello, world"), (1, "other text under one id"), (None, "no id"), (None, "no id"), (77, "Hello, world")]


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted([tuple(r) for r in aligned(docs, PATHS).collect()], key=repr)


def test_as_brute_force(spark, plain):
    want, pairs = plain.all(ROWS)
    assert got(spark, ROWS) == want
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert {tuple(r) for r in pair_table(docs, PATHS).collect()} == pairs


def test_random_characters(spark, plain):
    letters = "ab é  \n\t'’▁.,;0  \x1c中\U0001f600́​"
    draw = random.Random(3)
    rows = [(i, "".join(draw.choice(letters) for _ in range(draw.randint(1, 30)))) for i in range(400)]
    assert got(spark, rows) == plain.all(rows)[0]


def test_given_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t if t is None or len(t) < 3_000 else t[:3_000]) for i, t in rows]
    assert got(spark, rows) == plain.all(rows)[0]


def test_small_shards_blocks_portions_and_memory(spark, plain, monkeypatch):
    for name, value in {"SHARD_PAIRS": 20, "BLOCK": 8, "FAN_IN": 2, "PORTION_BYTES": 2_000, "UNITS_AT_ONCE": 3, "REMEMBERED": 5}.items():
        monkeypatch.setattr(alignment, name, value)
    want, pairs = plain.all(ROWS)
    assert got(spark, ROWS) == want
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert {tuple(r) for r in pair_table(docs, PATHS).collect()} == pairs


def test_dense_vectors_are_summed_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    monkeypatch.setattr(alignment, "BLOCK", 16)
    monkeypatch.setattr(alignment, "shuffle_partitions", lambda spark: 9)
    rows = [(task, (a << 32) | b, task + 1) for task in range(20) for a in range(12) for b in range(5)]
    counted = spark.createDataFrame(rows, "task int, pair long, docs long")
    hashes = alignment.perfect_hashes(counted.select("pair").distinct(), 2)
    dense = alignment.dense_counts(counted, hashes, 2).collect()
    assert len({(r.shard, r.block) for r in dense}) == len(dense)
    assert sum(np.frombuffer(r.counts, np.int64).sum() for r in dense) == 60 * sum(range(1, 21))


def test_one_very_long_text(spark):
    text = "some words and others " * 100_000
    rows = got(spark, [(1, text), (2, "some words")])
    alone = got(spark, [(1, "some words and others"), (2, "some words")])
    assert rows[0][1] == 100_000 * alone[0][1] + 1 and rows[0][3] == 100_000 * alone[0][3] + 1
    assert rows[1][:4] == alone[1][:4]


def test_empty_table_and_extra_columns(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    docs = spark.createDataFrame([(1, "x y")], "doc_id long, text string").withColumn("n_a", F.lit(9)).withColumn("PAIR", F.lit(1))
    assert aligned(docs, PATHS).columns == list(alignment.RESULT)


def test_perfect_hash():
    keys = np.unique(np.random.RandomState(1).randint(0, 1 << 50, 5_000))
    hashed = PerfectHash.of(keys)
    assert sorted(hashed.numbers(keys).tolist()) == list(range(len(keys)))
    again = PerfectHash.read(hashed.sizes, hashed.bits())
    assert (again.numbers(keys) == hashed.numbers(keys)).all()
    ordered = keys[np.argsort(hashed.numbers(keys))]
    strange = np.setdiff1d(keys + 1, keys)
    assert (alignment.verified(hashed, ordered, strange) == -1).all()
    assert (ordered[alignment.verified(hashed, ordered, keys)] == keys).all()
