import numpy as np
import pytest

from gristmill.llm.covertree import near_vectors


def expected(rows, cosine):
    """Brute force over all pairs."""
    vectors = {}
    for vec_id, embedding, label in rows:
        if vec_id is None or label is None or not embedding or any(x is None or not np.isfinite(x) for x in embedding):
            continue
        v = np.array(embedding, dtype=np.float32).astype(float)
        if (v != 0).any():
            vectors[vec_id] = (label, v)
    links = {r[0]: set() for r in rows if r[0] is not None}
    for a, (la, x) in vectors.items():
        for b, (lb, y) in vectors.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                links[a].add(b)
    root = {}
    for a in sorted(links):
        todo = [a] if a not in root else []
        while todo:
            b = todo.pop()
            if b not in root:
                root[b] = a
                todo += links[b]
    return {a: (len(links[a]), root[a], root[a] == a) for a in links}


def clustered(rng, n, dim, spread):
    centres = rng.randn(max(2, n // 12), dim)
    return [centres[rng.randint(len(centres))] + spread * rng.randn(dim) for _ in range(n)]


@pytest.mark.parametrize("block,centres", [(2048, 2000), (20, 100), (15, 4)])
@pytest.mark.parametrize("dim,spread", [(3, 0.1), (16, 0.15)])
def test_all_links_are_found(spark, block, centres, dim, spread):
    rng = np.random.RandomState(dim + block)
    rows = [(i, [float(np.float32(x)) for x in v], int(rng.randint(3))) for i, v in enumerate(clustered(rng, 150, dim, spread))]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, 0.93, block, centres).collect()}
    assert got == expected(rows, 0.93)


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1),
        (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1),
        (12, [1.0, -0.0], 1), (13, [1.0, 0.0], 2),
    ]
    df = spark.createDataFrame([(*r, "x") for r in [*rows, rows[0]]], "vec_id long, embedding array<float>, label int, N_LINKS string")
    found = near_vectors(df).collect()
    assert len(found) == len(rows) + 1
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == expected(rows, 0.93)
    assert near_vectors(df.limit(0)).collect() == []
    null = near_vectors(spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in null) == [(0, 0, True), (1, 0, True)]
