"""Cases that once lost data or gave wrong answers."""

import threading

import pytest

from gristmill.ml import models as Z
from gristmill.operators import charts as H, columns as C, nulls as N, profile as P, rows as R
from gristmill.plans.session import checkpoint, release
from gristmill.queries import QUERIES
from gristmill.sources.datasets import Dataset, recent_activity

SF = "/root/testdata/sf0.001"


def test_fill_uses_rows_without_key(spark):
    df = spark.createDataFrame([(None, 5.0)] + [(i, None) for i in range(300)], "k int, v double")
    assert N.fill_nulls(df, "ffill", ["v"], order_by="k").df.filter("v IS NULL").count() == 0
    assert N.fill_nulls(df, "bfill", ["v"], order_by="k").df.filter("v IS NULL").count() == 300


def test_fractions_do_not_fit_integers(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "k int, n bigint")
    for value in (2.5, "x", "2.5"):
        with pytest.raises(ValueError):
            N.fill_nulls(df, "constant", ["n"], value=value)
    with pytest.raises(ValueError):
        C.replace_values(df, {3: 2.7}, ["n"])
    assert [r.n for r in N.fill_nulls(df, "constant", ["n"], value=2.0).df.orderBy("k").collect()] == [2, 3]


def test_unknown_keys_and_unclear_patches(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with pytest.raises(ValueError, match="no row"):
        C.update_cell(df, {"k": 9}, "v", "x")
    twice = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    assert sorted(tuple(r) for r in C.update_cells(df, twice, "k", "v").collect()) == [(1, "x"), (2, "b")]
    with pytest.raises(Exception, match="different patches"):
        C.update_cells(df, spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), "k", "v").collect()


def test_values_of_another_kind(spark):
    df = spark.createDataFrame([(1, "1"), (None, None)], "n int, s string")
    for column, value in (("n", "abc"), ("s", 1)):
        assert R.filter_rows(df, column, "eq", value).count() == 0
        assert R.filter_rows(df, column, "ne", value).count() == 2
    assert R.filter_rows(df, "n", "eq", "1").count() == 1


def test_one_failing_chart_leaves_the_others(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("inf"))], "x string, y double")
    specs = [
        {"id": 1, "chart_type": "histogram", "chart_params": {"columns": ["y"]}},
        {"id": 2, "chart_type": "bar", "chart_params": {"x": "x", "y": "y", "agg": "count"}},
        {"id": 3, "chart_type": "nothing"},
    ]
    rows, errors = H.render_widgets(df, specs)
    assert "3" in errors and {r.widget_id for r in rows.collect()} | set(errors) == {"1", "2", "3"}
    assert rows.filter("widget_id = '2'").count() == 2


def test_nothing_is_cut_by_default(spark):
    df = spark.range(12_000).selectExpr("id AS k", "id % 30 AS g", "'x' AS x")
    assert H.line(df, "k", "g", "k").count() == 12_000
    assert [r.rank for r in H.line(df, "k", "g", "k", points=3).orderBy("rank").collect()] == [1, 2, 3]
    assert H.bar(df, "x", "k", "count", group_by="g").count() == 30
    assert H.bar(df, "x", "k", "count", group_by="g", max_groups=4).count() == 4
    assert P.preview(df, "k", 0).count() == 12_000
    assert tuple(P.preview_info(df, 0).first()) == (12_000, 12_000, False)


def test_depth_is_an_error_not_a_lower_tree():
    with pytest.raises(ValueError, match="max_depth"):
        Z.check_params("random_forest", {"max_depth": 40})


def test_one_of_two_writers_wins(spark, base, tmp_path):
    data = Dataset.create(spark, str(tmp_path), "d", base)
    outcome = []

    def write(name):
        try:
            outcome.append(Dataset(spark, str(tmp_path), "d").commit(base, name))
        except RuntimeError as problem:
            outcome.append(problem)

    writers = [threading.Thread(target=write, args=(n,)) for n in "AB"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    versions = [r.version for r in data.manifest().collect()]
    assert len(versions) == len(set(versions))
    assert sum(isinstance(x, RuntimeError) for x in outcome) + len(versions) == 3
    # A writer that died after its claim: the claim can be given up.
    head = data.head()["version"]
    data._claim(head + 1)
    with pytest.raises(RuntimeError, match="claimed"):
        data.undo()
    data.release_claim(head + 1)
    assert data.undo() == head + 1
    assert [r.version for r in recent_activity(data.manifest(), 1).collect()] == [head + 1]


def test_sampling_of_order_needs_no_top_of_all_rows(spark):
    for name in ("q_fill_ffill", "q_encode_label", "q_corr_spearman"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "GlobalLimit" not in plan and "TakeOrdered" not in plan


def test_hot_keys_stay_in_order(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id")
    from gristmill.plans.ordering import with_row_number

    rows = with_row_number(df, ["k", "id"], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(20_000))
    assert [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)
    same = spark.range(5_000).selectExpr("1 AS k")
    assert with_row_number(same, ["k"], "n").select("n").distinct().count() == 5_000


def test_steps_can_be_released(spark):
    written = checkpoint(spark.range(3))
    path = written.inputFiles()[0].removeprefix("file://")
    release(spark)
    import os

    assert not os.path.exists(path)


def test_large_kendall_classes_are_cut_again(spark):
    from gristmill.operators.rank_correlation import correlation_kendall

    df = spark.range(400).selectExpr("pmod(id * 37, 101) AS a", "pmod(id * id, 83) AS b", "id % 7 AS c", "CASE WHEN id % 5 > 0 THEN id END AS d")
    whole = {(r.column_a, r.column_b): r.r for r in correlation_kendall(df).collect()}
    small = {(r.column_a, r.column_b): r.r for r in correlation_kendall(df, cuts=3, limit=10).collect()}
    assert small == whole
    values = [tuple(r) for r in df.select("a", "b").collect()]
    score = sum((x > u) * 1.0 * ((y > v) - (y < v)) + (x < u) * 1.0 * ((y < v) - (y > v)) for i, (x, y) in enumerate(values) for u, v in values[:i])
    n0 = len(values) * (len(values) - 1) / 2
    tie = lambda k: sum(m * (m - 1) / 2 for m in __import__("collections").Counter(v[k] for v in values).values())
    assert whole["a", "b"] == pytest.approx(score / ((n0 - tie(0)) * (n0 - tie(1))) ** 0.5, abs=1e-4)


@pytest.mark.parametrize("bound", [200_000, 50])
def test_quantiles_on_the_edge_of_heavy_values(spark, monkeypatch, bound):
    import numpy as np

    from gristmill.plans import stats

    monkeypatch.setattr(stats, "WHOLE_BRACKET", bound)
    df = spark.range(20_000).selectExpr(
        "CASE WHEN id < 9990 THEN 0D WHEN id < 10010 THEN id / 1000 ELSE 50D END AS a", "CAST(pmod(id * 7919, 20000) AS DOUBLE) AS b",
        "CASE WHEN id % 3 = 0 THEN NULL ELSE sqrt(id) END AS c", "CAST(NULL AS DOUBLE) AS d",
    )
    ps = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = stats.quantiles(df, ["a", "b", "c", "d"], ps)
    rows = df.toPandas()
    for i, c in enumerate("abc"):
        want = np.quantile(rows[c].dropna(), ps)
        assert [got[i, j] for j in range(len(ps))] == pytest.approx(list(want), abs=1e-12)
    assert all(got[3, j] is None for j in range(len(ps)))


def test_large_keys_leave_no_product(spark, tmp_path):
    rows = [(1, 1, 0), (1, 2, 9_223), (2, 1, 9_224), (2, 2, 20_000), (3, 1, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["q_add_column_overflow"](spark, str(tmp_path)).orderBy("l_orderkey", "l_linenumber")
    assert [f.dataType.simpleString() for f in found.schema][2:] == ["bigint", "bigint", "bigint"]
    assert [(r.a, r.p) for r in found.collect()] == [(0, 0), (9_223 * 10**15, None), (None, None), (None, None), (None, None)]
