import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gristmill.llm.tokencount import MARK, Counter, Vocabulary, read_vocabulary, token_counts
from gristmill.llm.words import text_bytes

PATH = "/opt/tokenizers/piece_bpe_32k.model"
ODD = [
    None, "", " ", "  ", "\n", " \n ", "a", " a", "a ", "  a  b ", "a\nb", "a \n b\t\tc", "x" * 500, "▁a ▁", "a▁ b",
    "zażółć gęślą 亜 \U0001f9ff", "the the\r\n\r\nthe", " x　y", "aaaa" * 50 + " " * 40 + "b",
]


def exact(vocabulary):
    """The same vocabulary in a public tokenizer, over whole texts."""
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), *vocabulary.pieces]
    if vocabulary.bytes_for_unknown:
        low = min(s for _, s in vocabulary.pieces)
        pieces += [(f"<0x{i:02X}>", low) for i in range(256)]
    model = Tokenizer(models.Unigram(pieces, 0, vocabulary.bytes_for_unknown))
    return lambda text: len(model.encode(MARK + text.replace(" ", MARK)).ids) if text else 0


def counts(counter, texts):
    return counter.texts(*text_bytes(pa.array(texts, pa.string())))[0].tolist()


def test_whole_documents_match_the_public_tokenizer():
    vocabulary = read_vocabulary(PATH)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ODD
    expect = exact(vocabulary)
    assert counts(Counter(vocabulary), texts) == [expect(t or "") for t in texts]


@pytest.mark.parametrize("bytes_for_unknown", [True, False])
def test_ties_and_unknown_characters(bytes_for_unknown):
    rng = np.random.RandomState(1)
    letters = "ab▁c"
    made = {"".join(rng.choice(list(letters), rng.randint(1, 4))): float(-rng.randint(1, 4)) for _ in range(30)}
    vocabulary = Vocabulary(sorted(made.items()), bytes_for_unknown)
    texts = ["".join(rng.choice(list("abcd é\n"), rng.randint(0, 12))) for _ in range(300)]
    expect = exact(vocabulary)
    assert counts(Counter(vocabulary), texts) == [expect(t) for t in texts]


def test_ties_within_words():
    rng = np.random.RandomState(2)
    made = {"▁" * rng.randint(0, 3) + "".join(rng.choice(list("abc"), rng.randint(1, 4))): float(-rng.randint(1, 3)) for _ in range(40)}
    vocabulary = Vocabulary(sorted(made.items()), True)
    counter = Counter(vocabulary)
    assert counter.cuttable
    texts = ["".join(rng.choice(list("abcd  \n"), rng.randint(0, 14))) for _ in range(400)]
    expect = exact(vocabulary)
    assert counts(counter, texts) == [expect(t) for t in texts]


def test_query_shape(spark):
    rows = spark.createDataFrame([(1, "a b", "x"), (None, None, "y"), (1, "a b", "x")], "doc_id long, text string, TOKENS string")
    got = token_counts(rows, Vocabulary([("▁a", -1.0), ("▁", -2.0)], True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (1, 3), (1, 3)]
    assert token_counts(rows.limit(0), Vocabulary([("a", -1.0)], True)).collect() == []
