import numpy as np
import pytest

from gristmill.llm import substrings as S
from gristmill.llm.substrings import Automaton, without_repeats


def brute(rows, window=13):
    first, out = {}, {}
    for doc, text in rows:
        words = (text or "").split()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    for doc, text in rows:
        words = (text or "").split()
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        out[doc] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


@pytest.mark.parametrize("crowd,shard", [(1000, 4000), (3, 5), (0, 1)])
def test_matches_brute_force(spark, crowd, shard):
    rng = np.random.RandomState(crowd)
    say = lambda n: [f"w{x}" for x in rng.randint(0, 60, n)]
    passages = [say(int(n)) for n in (13, 14, 30, 90, 200)] + [["ing"] * 150, ["a", "b"] * 60]
    line = say(16)
    rows = []
    for doc in rng.permutation(80):
        words = say(int(rng.randint(0, 60)))
        for p in rng.choice(len(passages), rng.randint(0, 3)):
            a, b = sorted(rng.randint(0, len(passages[p]) + 1, 2))
            words += passages[p][a:b] + say(int(rng.randint(0, 20)))
        if doc % 3 == 0:
            words += line + say(5)
        rows.append((int(doc), " ".join(words)))
    rows += [(200 + i, rows[0][1]) for i in range(5)]
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd, shard=shard).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute(rows)


@pytest.mark.parametrize("crowd", [1000, 0])
def test_repeated_rows_match_brute_force(spark, crowd):
    rng = np.random.RandomState(7)
    say = lambda n: [f"w{x}" for x in rng.randint(0, 60, n)]
    passages = [say(60), say(40), ["ing"] * 100]
    rows = []
    for doc in range(30):
        words = say(10)
        for p in rng.choice(len(passages), 2):
            a, b = sorted(rng.randint(0, len(passages[p]) + 1, 2))
            words += passages[p][a:b] + say(5)
        rows.append((doc, " ".join(words)))
    rows += [row for row in rows[:10] for _ in range(3)]
    null = 1 << 40  # larger than any other id
    rows += [(null, " ".join(say(20) * 2 + passages[0][5:50]))] * 4
    given = [(None if doc == null else doc, text) for doc, text in rows]
    got = without_repeats(spark.createDataFrame(given, "doc_id long, text string").repartition(3), crowd=crowd).collect()
    want = brute(rows)
    seen = sorted((null if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got)
    assert seen == sorted((doc, *want[doc]) for doc, _ in rows)


def test_automaton_knows_first_documents():
    rng = np.random.RandomState(0)
    texts = [rng.randint(0, 3, rng.randint(5, 40)).tolist() for _ in range(30)]
    machine = Automaton()
    for doc, text in enumerate(texts):
        machine.add(text, doc)
    for text in texts + [rng.randint(0, 4, 40).tolist()]:
        want = [min((d for d, t in enumerate(texts) if any(t[k : k + 5] == text[i : i + 5] for k in range(len(t) - 4))), default=-1) for i in range(len(text) - 4)]
        assert machine.statistics(text, 5) == want


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, None, "a"), (2, "", "b"), (3, text, "c"), (3, text, "c"), (None, text, "d"), (4, "x\x1cy z é", "e"), (0, "q " + text, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, KEPT string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_removed, r.kept) for r in without_repeats(df).collect())
    assert got == [(-1, 20, 20, ""), (0, 21, 0, "q " + text), (1, 0, 0, ""), (2, 0, 0, ""), (3, 20, 20, ""), (3, 20, 20, ""), (4, 2, 0, "x\x1cy z é")]
    assert without_repeats(df.limit(0)).collect() == []


def by_row(rows, window=13):
    """Brute force per row: texts may share an id."""
    first = {}
    for doc, text in rows:
        words = (text or "").split()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").split()
        gone = {i + j for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < doc for j in range(window)}
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("crowd,shard", [(1000, 4000), (0, 1)])
def test_two_texts_under_one_id(spark, crowd, shard):
    rng = np.random.RandomState(9)
    say = lambda n: [f"w{x}" for x in rng.randint(0, 5_000, n)]
    passage, other = say(20), say(30)
    rows = [(1, passage), (5, say(40)), (5, say(11) + passage), (5, say(11) + passage), (3, other + say(4)), (3, say(50)), (4, say(9) + other[:15]), (4, other), (4, say(3))]
    rows += [(int(d), say(int(rng.randint(0, 20))) + passage[: int(rng.randint(10, 21))]) for d in rng.randint(0, 4, 12)]
    rows = [(d, " ".join(w)) for d, w in rows]
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd, shard=shard).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == by_row(rows)


def test_two_texts_without_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    own = " ".join(f"q{i}" for i in range(40))
    got = without_repeats(spark.createDataFrame([(1, passage), (None, own), (None, "a b c " + passage)], "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(20, 0), (23, 20), (40, 0)]


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    got = without_repeats(spark.createDataFrame([(1, "w5 " * 3 + " ".join(f"w{i}" for i in range(100_000, 100_050))), (2, long)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == [(1, 53, 0), (2, 300_000, 50)]


def test_whole_pieces_of_every_length(spark):
    """A piece of up to 64 windows that repeats is removed whole, its neighbours stay."""
    rows = []
    for n in (13, 14, 74, 75, 76, 77, 140):
        run = " ".join(f"r{n}x{i}" for i in range(n))
        rows += [(2 * n, run), (2 * n + 1, f"before {run} after")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in S.without_repeats(table).collect()}
    for n in (13, 14, 74, 75, 76, 77, 140):
        assert got[2 * n][:2] == (n, 0)
        assert got[2 * n + 1] == (n + 2, n, "before after")


def test_texts_are_read_as_often_as_needed(spark, monkeypatch):
    """Places and words of pieces are each taken from the texts once, whatever reads them later."""
    written = []
    kept = S.settled
    monkeypatch.setattr(S, "settled", lambda df: written.append(df) or kept(df))
    run = " ".join(f"r{i}" for i in range(40))
    table = spark.createDataFrame([(i, f"{run} {i} {run} x{i}") for i in range(6)], "doc_id long, text string")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in [S.removals(table), *written]]
    assert [plan.count("MapInArrow") for plan in plans] == [0, 2, 1, 0, 0, 1]
