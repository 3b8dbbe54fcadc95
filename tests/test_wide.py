"""Pairs of columns of wide tables, counted and multiplied as matrices, against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.operators import association as A, eda as E, rank_correlation as K
from gristmill.plans import pairsums
from gristmill.plans.pairsums import pair_cells, pair_moments


def numbers(spark, rows=300, width=22, seed=3):
    """Columns with and without nulls, one constant, one constant beside a partner, one all null."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(rows, width)).round(2) + 1e6, columns=[f"c{i}" for i in range(width)])
    pdf["c1"] += pdf["c0"]
    for i in range(0, width, 2):
        pdf.loc[rng.random(rows) < 0.3, f"c{i}"] = np.nan
    pdf["same"] = 4.0
    pdf["void"] = np.nan
    pdf["beside"] = np.where(pdf["c0"].isna(), rng.normal(size=rows), 2.0)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf))
    return pdf, df.repartition(5)


def test_wide_pearson_equals_pandas(spark, monkeypatch):
    pdf, df = numbers(spark)
    width = len(pdf.columns)
    want = pdf.corr()
    got = {(r.column_a, r.column_b): r.r for r in E.correlation_pearson(df).collect()}
    assert len(got) == width * width and width * (width - 1) // 2 > E.PAIRS_PER_JOB
    for (a, b), r in got.items():
        if "beside" in (a, b) and "c0" in (a, b) or math.isnan(want.at[a, b]):
            assert r is None, (a, b)
        else:
            assert r == pytest.approx(want.at[a, b], abs=1.01e-4), (a, b)
    monkeypatch.setattr(E, "PAIRS_PER_JOB", 10_000)
    assert got == {(r.column_a, r.column_b): r.r for r in E.correlation_pearson(df).collect()}


def test_wide_co_nulls_equal_the_narrow_way(spark, monkeypatch):
    _, df = numbers(spark)
    df = df.withColumn("twin", F.when(F.col("c0").isNotNull(), 1)).withColumn("anti", F.when(F.col("c0").isNull(), 1))
    wide = {tuple(r) for r in E.co_null_pairs(df).collect()}
    monkeypatch.setattr(E, "PAIRS_PER_JOB", 10_000)
    assert wide == {tuple(r) for r in E.co_null_pairs(df).collect()}
    assert ("c0", "twin", 1.0) in wide and ("anti", "c0", -1.0) in wide


def test_moments_of_small_blocks_and_empty_tables(spark, monkeypatch):
    pdf, df = numbers(spark, rows=40, width=3)
    columns = [F.col(c) for c in pdf]
    rows = {(r.i, r.j): r for r in pair_moments(df, columns).collect()}
    for i, a in enumerate(pdf):
        for j, b in enumerate(pdf):
            both = pdf[[a]].assign(other=pdf[b]).dropna()
            r = rows[i, j]
            assert r.n == len(both)
            assert r.p == pytest.approx((both[a] * both["other"]).sum())
            assert (r.s, r.q) == (pytest.approx(both[a].sum()), pytest.approx((both[a] ** 2).sum()))
            if len(both):
                assert (r.lo, r.hi) == (both[a].min(), both[a].max())
    assert pair_moments(df.limit(0), columns).count() == 0
    assert all(r.r is None for r in E.correlation_pearson(df.limit(0)).collect())


def test_cells_are_counted_across_blocks(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.choice(["x", "y", ""], 500), "b": rng.choice(list("pqrst"), 500), "c": [f"id{i}" for i in range(500)]})
    df = spark.createDataFrame(pdf).repartition(7)
    got = {(r.i, r.j, r.a, r.b): r.o for r in pair_cells(df, [F.col(c) for c in "abc"]).collect()}
    want = {}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        for pair, n in pdf.groupby(["abc"[i], "abc"[j]]).size().items():
            want[i, j, *pair] = n
    assert got == want


def test_blocks_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": list(range(10))})
    assert [t.num_rows for t in pairsums._blocks(iter([batch] * 7), rows=25)] == [30, 30, 10]
    assert [t.num_rows for t in pairsums._blocks(iter([batch] * 3), size=1)] == [10, 10, 10]
    assert list(pairsums._blocks(iter([]))) == []


def test_wide_association_equals_the_narrow_way(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({f"k{i:02d}": rng.choice(["u", "v", "w", None][: 2 + i % 3], 200) for i in range(22)})
    pdf["same"] = "one"
    df = spark.createDataFrame(pdf, ", ".join(f"{c} string" for c in pdf)).repartition(4)
    wide = {(r.column_a, r.column_b): r.v for r in A.categorical_association(df).collect()}
    assert len(wide) == 23 * 23
    monkeypatch.setattr(A, "PAIRS_PER_ROW", 10_000)
    narrow = {(r.column_a, r.column_b): r.v for r in A.categorical_association(df).collect()}
    assert wide.keys() == narrow.keys()
    for pair, v in wide.items():
        assert v == pytest.approx(narrow[pair], abs=1.01e-4), pair


def test_spearman_of_long_rankings_without_broadcast(spark, monkeypatch):
    pdf, df = numbers(spark, width=4)
    whole = {(r.column_a, r.column_b): r.r for r in K.correlation_spearman(df).collect()}
    monkeypatch.setattr(K, "BROADCAST_ROWS", 0)
    assert whole == {(r.column_a, r.column_b): r.r for r in K.correlation_spearman(df).collect()}
    assert whole["same", "same"] is None and whole["void", "c1"] is None and whole["c0", "beside"] is None
    pair = pdf[["c0", "c1"]].dropna().rank()
    assert whole["c0", "c1"] == pytest.approx(pair["c0"].corr(pair["c1"]), abs=1.01e-4)
    assert all(r.r is None for r in K.correlation_spearman(df.limit(0)).collect())


def test_spearman_counts_each_column_once(spark, monkeypatch):
    """Whatever the gaps of the partners, a column's values are counted from one copy of each row."""
    rows = [tuple(None if (i + 3 * c) % 7 == 0 and c % 2 else (i * (c + 3)) % (5 + 40 * c) / 2 for c in range(5)) for i in range(400)]
    names = [f"a{c}" for c in range(5)]
    table = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    seen = []
    long_rows = K._long_rows
    monkeypatch.setattr(K, "_long_rows", lambda *a: seen.append((len(a[1]), long_rows(*a))) or seen[-1][1])
    monkeypatch.setattr(K, "MASK_BITS", 1)
    got = {(r.column_a, r.column_b): r.r for r in K.correlation_spearman(table).collect()}
    want = pd.DataFrame(rows, columns=names).corr("spearman").round(4)
    assert all(got[a, b] == pytest.approx(want.loc[a, b], abs=1e-4) for a in names for b in names)
    assert [n for n, _ in seen] == [5, 10]
    assert all("filter(array" not in df._jdf.queryExecution().optimizedPlan().toString() for _, df in seen)
