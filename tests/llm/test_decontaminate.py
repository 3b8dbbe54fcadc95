import numpy as np

from gristmill.llm.decontaminate import RUN, answer_length, build, clean, contaminated, edits_within, index_of, tokens, wand, word_runs


def brute(text, item, least=0.8):
    words, own = tokens(text or ""), tokens(item or "")
    if len(own) < RUN:
        return False
    held, wanted = set(word_runs(words)), set(word_runs(own))
    return len(held & wanted) >= least * len(wanted) - 1e-9


def found(documents, benchmark, **kw):
    return {r.doc_id: set(r["items"]) for r in contaminated(documents, benchmark, **kw).collect()}


def test_all_contained_items_are_found(spark):
    rng = np.random.RandomState(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "Été", "à"] * 40
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(rng.choice([6, 12, 40, 63, 65, 300])))) for i in range(40)] + [(90, "the of the of the of the of"), (91, "the of"), (92, None), (93, "")]
    documents = []
    for d in range(120):
        text = say(int(rng.randint(5, 400)))
        for i in rng.choice(len(items), rng.randint(0, 3)):
            own = (items[i][1] or "").split()
            if own:
                lose = rng.randint(0, max(1, len(own) // 6))
                part = own[lose:] if rng.rand() < 0.5 else own[: len(own) - lose]
                text += " " + " ".join(part).upper().replace("W", "w") + ", " + say(int(rng.randint(1, 90)))
        documents.append((d, text))
    df = spark.createDataFrame(documents, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = found(df, bench)
    for doc, text in documents:
        want = {i for i, t in items if brute(text, t)}
        assert got[doc] <= want
        # An item may also need its answer, the last sentence, which here is all of it.
        assert got[doc] == want
    assert found(df, bench, shard_items=5) == got


def fewest_edits(part, whole):
    """Edit distance of ``part`` to the nearest piece of ``whole``, cell by cell."""
    row = [0] * (len(whole) + 1)
    for n, word in enumerate(part, 1):
        new = [n]
        for j, other in enumerate(whole):
            new.append(min(row[j] + (word != other), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edits_are_the_fewest():
    rng = np.random.RandomState(8)
    for _ in range(300):
        part, whole = rng.randint(0, 5, rng.randint(0, 8)), rng.randint(0, 5, rng.randint(0, 20))
        assert edits_within(part, whole) == fewest_edits(part.tolist(), whole.tolist())


def test_answers_of_sentences(spark):
    """Items of question and answer; copies are whole, edited in the answer, or of the question alone."""
    rng = np.random.RandomState(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items, documents, expected = [], [], {}
    for i in range(60):
        question, answer = say(65), say(int(rng.randint(1, 16))).split()
        items.append((i, f"{question}? {' '.join(answer)}."))
        at = rng.randint(len(answer))
        edits = {
            "whole": answer,
            "changed": answer[:at] + ["zzz"] + answer[at + 1 :],
            "lost": answer[:at] + answer[at + 1 :],
            "added": answer[:at] + ["zzz"] + answer[at:],
            "other": say(len(answer)).split(),
        }
        for kind, words in edits.items():
            doc = len(documents)
            documents.append((doc, f"{say(40)} {question}? {' '.join(words)}. {say(int(rng.randint(1, 90)))}"))
            if kind != "other":
                expected[doc] = {i}
            elif len(answer) > 2:
                expected[doc] = set()
    got = found(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {d: got[d] for d in expected} == expected
    for doc, text in documents:
        want = set()
        for i, item in items:
            own = tokens(item)
            tail, runs, held = answer_length(item), word_runs(own), set(word_runs(tokens(text)))
            last = set(runs[-tail:])
            close = fewest_edits(own[-tail:], tokens(text)) <= max(1, int(0.2 * tail + 1e-9))
            if brute(text, item) and (close or len(last & held) >= 0.8 * len(last) - 1e-9):
                want.add(i)
        assert got[doc] == want


def test_wand_scores_what_a_full_scan_scores():
    rng = np.random.RandomState(1)
    members = [(i, [b"t%d" % w for w in rng.zipf(1.5, 20) % 40], 3) for i in range(100)]
    index = index_of(members, 64, 0.8)
    for _ in range(200):
        terms = np.unique(rng.choice(len(index.vocabulary), rng.randint(1, 25)))
        score = np.zeros(len(members))
        for t in terms:
            score[index.postings[t][0]] += index.postings[t][1]
        want = set(np.flatnonzero(score >= index.floor + 1e-9).tolist())
        got = [x for block in range(len(index.block_need)) for x in wand(index, terms.tolist(), block)]
        assert want <= {i for i, _ in got}
        assert all(abs(score[i] - s) < 1e-9 for i, s in got)


def test_odd_rows(spark):
    item = "one two three four five six seven eight."
    rows = [(1, f"x {item} y", "a"), (1, f"x {item} y", "a"), (2, None, "b"), (3, "", "c"), (None, item, "d"), (4, "one two three", "e"), (5, "clean words " * 50_000 + item, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ITEMS string")
    bench = spark.createDataFrame([(7, item), (7, item), (None, "a b c d e f g")], "item_id long, text string")
    got = contaminated(df, bench).collect()
    assert sorted((r.doc_id or 0, r["items"]) for r in got) == [(0, [7]), (1, [7]), (1, [7]), (2, []), (3, []), (4, []), (5, [7])]
    stay = clean(df, bench)
    assert stay.columns == df.columns and sorted(r.doc_id for r in stay.collect()) == [2, 3, 4]
    assert clean(df, bench.limit(0)).count() == len(rows)
    assert contaminated(df.limit(0), bench).collect() == []
    assert build([], 0.8) == []
