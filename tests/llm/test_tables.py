import numpy as np
import pytest

from gristmill.llm.tables import components, free_name, small


def brute(edges):
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


@pytest.mark.parametrize("kind", ["path", "star", "random", "two"])
def test_components(spark, kind):
    rng = np.random.RandomState(4)
    edges = {
        "path": [(i, i + 1) for i in rng.permutation(60).tolist()],
        "star": [(50, i) for i in range(100)],
        "random": [tuple(x) for x in rng.randint(0, 120, (90, 2)).tolist()],
        "two": [(1, 2), (2, 1), (3, 3)],
    }[kind]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_helpers(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert components(empty).collect() == []
    assert free_name(spark.createDataFrame([(1,)], "N long"), "n") == "n_"
    assert small(spark.createDataFrame([(None,), ("x",)], "t string")).count() == 2
