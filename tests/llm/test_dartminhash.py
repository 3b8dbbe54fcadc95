from collections import Counter

import numpy as np
import pytest

from gristmill.llm.dartminhash import deduplicated, near_duplicates, throw
from gristmill.llm.words import mix


def runs_of(text):
    words = (text or "").split()
    if 0 < len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 0.0


def expected(rows, least=0.8):
    """Class of each id by brute force over all pairs."""
    sets = {i: runs_of(t) for i, t in rows if i is not None}
    root = {}
    for a in sorted(sets):
        todo = [] if a in root else [a]
        while todo:
            b = todo.pop()
            if b not in root:
                root[b] = a
                todo += [c for c in sets if c not in root and similarity(sets[b], sets[c]) >= least - 1e-9]
    return root


def changed(rng, words, share):
    out = list(words)
    for i in rng.choice(len(out), max(1, int(share * len(out))), replace=False):
        out[i] = f"x{rng.randint(10**6)}"
    return out


@pytest.mark.parametrize("weights", ["whole", "fractions"])
def test_agreement_is_weighted_similarity(weights):
    rng = np.random.RandomState(3)
    key = mix(np.arange(60, dtype=np.uint64))
    a, b = rng.randint(0, 4, 60).astype(float), rng.randint(0, 4, 60).astype(float)
    if weights == "fractions":
        a, b = a * rng.rand(60), b * rng.rand(60)
    owner = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
    drawn = throw(owner, np.r_[key[a > 0], key[b > 0]], np.r_[a[a > 0], b[b > 0]], 3, 4000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((drawn[0] == drawn[1]).mean() - true) < 0.035
    assert (drawn[2] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


@pytest.mark.parametrize("group", [24, 3])
def test_classes_match_brute_force(spark, group):
    rng = np.random.RandomState(group)
    rows, n = [], 0
    for size, share in ((60, 0.06), (8, 0.02), (3, 0.01)):
        base = [f"w{rng.randint(500)}" for _ in range(120)]
        for _ in range(size):
            rows.append((n, " ".join(changed(rng, base, share * rng.rand()))))
            n += 1
    rows += [(n + i, " ".join(f"v{rng.randint(10**6)}" for _ in range(40))) for i in range(20)]
    rows += [(1000 + i, rows[3][1]) for i in range(15)] + [(2000, "the " * 40), (2001, "the " * 41), (2002, "a b"), (2003, "a  b"), (2004, "a c")]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.8, group).collect()}
    assert got == expected(rows)


def test_odd_rows(spark):
    rows = [(1, None, "p"), (2, "", "q"), (3, " \n", "r"), (None, "a b c", "s"), (None, "a b c", "s"), (7, "a b c", "t"), (7, "a b c", "t"), (9, "a b c", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, BANDS string")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (9, 7, False)], key=str)
    stay = deduplicated(df)
    assert stay.columns == df.columns
    assert sorted((r.doc_id for r in stay.collect()), key=str) == sorted([1, 2, 3, 7, None, None], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    rng = np.random.RandomState(2)
    say = lambda n: [f"w{x}" for x in rng.randint(0, 9_000, n)]
    a, b, c, d = (say(60) for _ in range(4))
    rows = [(1, a), (7, a), (7, b), (3, c), (3, d), (5, changed(rng, c, 0.01)), (2, changed(rng, d, 0.01)), (9, say(40)), (9, say(40)), (3, c)]
    rows = [(i, " ".join(t)) for i, t in rows] + [(None, " ".join(a)), (None, " ".join(b)), (8, ""), (8, " ".join(b[:3]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS of", "2 AS T")
    sets = [runs_of(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:  # smallest reachable row number by brute force
        for i in range(len(rows)):
            for j in range(len(rows)):
                linked = rows[i][0] is not None and rows[j][0] is not None and (rows[i] == rows[j] or similarity(sets[i], sets[j]) >= 0.8)
                if linked:
                    root[i] = root[j] = min(root[i], root[j])
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root) if rows[r][0] is not None}
    got = near_duplicates(frame).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter((i, least.get(root[k])) for k, (i, _) in enumerate(rows))
    stay = [(r.doc_id, r.text) for r in deduplicated(frame).collect()]
    assert deduplicated(frame).columns == frame.columns and len(stay) == len({r for r in root})
    for r in least:  # one text of each class, from its smallest id
        members = {rows[i] for i in range(len(rows)) if root[i] == r}
        assert [x[0] for x in stay if x in members] == [least[r]]
    assert sum(i is None for i, _ in stay) == 2


def test_the_other_text_of_a_dropped_id_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    stay = deduplicated(spark.createDataFrame([(1, a), (7, a), (7, b)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, stay)) == [(1, a), (7, b)]
