import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gristmill.operators import association as A, charts as H, eda as E, outliers as O, profile as P
from gristmill.operators import rank_correlation as K
from gristmill.plans import ordering, stats

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, seed, n=300, ties=6, null_share=0.15):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "id": rng.permutation(n),
            "x": rng.integers(0, ties, n).astype(float),
            "y": np.round(rng.normal(size=n), 1),
            "z": rng.exponential(size=n),
        }
    )
    for c in ("x", "y"):
        pdf.loc[rng.random(n) < null_share, c] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, x double, y double, z double")
    return pdf, df


@SETTINGS
@given(seed=st.integers(0, 10_000), n=st.sampled_from([1, 2, 3, 17, 400]))
def test_quantiles_equal_pandas(spark, seed, n):
    pdf, df = frame(spark, seed, n)
    ps = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = stats.quantiles(df, ["x", "y", "z"], ps)
    for i, c in enumerate(["x", "y", "z"]):
        for j, p in enumerate(ps):
            want = pdf[c].quantile(p)
            if math.isnan(want):
                assert got[i, j] is None
            else:
                assert got[i, j] == pytest.approx(want, abs=1e-12)


def test_quantile_brackets_are_exact_beyond_the_short_column_path(spark, monkeypatch):
    monkeypatch.setattr(stats, "WHOLE_BRACKET", 100)
    pdf, df = frame(spark, 5, 3000, ties=4)
    got = stats.quantiles(df, ["x", "z"], [0.0, 0.1, 0.5, 0.99, 1.0], accuracy=100)
    for i, c in enumerate(["x", "z"]):
        for j, p in enumerate([0.0, 0.1, 0.5, 0.99, 1.0]):
            assert got[i, j] == pytest.approx(pdf[c].quantile(p), abs=1e-12)


@SETTINGS
@given(seed=st.integers(0, 10_000))
def test_fill_along_equals_pandas(spark, seed):
    from gristmill.operators.nulls import fill_nulls

    pdf, df = frame(spark, seed, 200, null_share=0.7)
    ordered = pdf.sort_values("id")
    for strategy in ("ffill", "bfill"):
        got = fill_nulls(df.repartition(7), strategy, ["x", "y"], order_by="id").df.orderBy("id").toPandas()
        want = getattr(ordered[["x", "y"]], strategy)()
        np.testing.assert_array_equal(got[["x", "y"]].to_numpy(dtype=float), want.to_numpy())


def test_row_numbers_are_contiguous(spark):
    df = spark.range(5000).selectExpr("id % 7 AS a", "id AS b")
    rows = ordering.with_row_number(df, ["a", "b"], "n").orderBy("a", "b").collect()
    assert [r["n"] for r in rows] == list(range(5000))


def test_hot_keys_share_their_bucket_evenly(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS b")
    sizes = [r["count"] for r in ordering.with_buckets(df, ["k", "b"], 16).groupBy(ordering.BUCKET).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 20_000 / 4


def test_top_per_group_with_salts(spark, monkeypatch):
    monkeypatch.setattr(ordering, "GROUP_LIMIT", 3)
    df = spark.range(1000).selectExpr("id % 2 AS g", "id AS v")
    rows = ordering.top_per_group(df, ["g"], [F.col("v").desc()], 5, "n").collect()
    assert sorted(r["v"] for r in rows) == list(range(990, 1000))


@SETTINGS
@given(seed=st.integers(0, 10_000))
def test_pearson_and_spearman_equal_pandas(spark, seed):
    pdf, df = frame(spark, seed)
    df = df.withColumn("one", F.lit(1.0))
    pdf["one"] = 1.0
    cols = ["x", "y", "z", "one"]
    want = pdf[cols].corr().round(4)
    for r in E.correlation_pearson(df, cols).collect():
        check(r["r"], want.at[r["column_a"], r["column_b"]])
    rows = K.correlation_spearman(df, cols).collect()
    assert len(rows) == 16
    for r in rows:
        a, b = r["column_a"], r["column_b"]
        pair = pdf[[a, b]].dropna() if a != b else pdf[[a]].dropna()
        ranks = pair.rank()
        check(r["r"], ranks[a].corr(ranks[b]) if a != "one" and b != "one" else math.nan)


def check(got, want):
    if want is None or math.isnan(want):
        assert got is None
    else:
        assert got == pytest.approx(want, abs=1.01e-4)


def tau_b(x, y):
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    top = (dx * dy).sum()
    return top / math.sqrt((dx != 0).sum() * (dy != 0).sum())


@SETTINGS
@given(seed=st.integers(0, 10_000), ties=st.sampled_from([2, 6, 1000]), cuts=st.sampled_from([1, 5, 40]))
def test_kendall_equals_brute_force(spark, seed, ties, cuts):
    pdf, df = frame(spark, seed, 250, ties)
    got = {(r["column_a"], r["column_b"]): r["r"] for r in K.correlation_kendall(df, ["x", "y", "z"], cuts).collect()}
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        pair = pdf[[a, b]].dropna()
        assert got[a, b] == pytest.approx(tau_b(pair[a].to_numpy(), pair[b].to_numpy()), abs=1.01e-4)
        assert got[a, b] == got[b, a]


@SETTINGS
@given(data=st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 4)), min_size=1, max_size=40))
def test_discordant_weight(data):
    x, y, w = (np.array(c, dtype=float) for c in zip(*data))
    want = sum(
        w[i] * w[j] for i in range(len(x)) for j in range(len(x)) if x[i] < x[j] and y[i] > y[j]
    )
    assert K.discordant_weight(x, y, w) == want


def test_distribution_equals_numpy(spark):
    pdf, df = frame(spark, 3)
    bins = E.distribution_bins(df, ["y", "z"], 13).toPandas()
    for c in ("y", "z"):
        counts, edges = np.histogram(pdf[c].dropna(), bins=13)
        got = bins[bins["column"] == c].sort_values("bin")
        assert got["count"].tolist() == counts.tolist()
        np.testing.assert_allclose(got["range_start"], edges[:-1], atol=1e-4)
    shape = {r["column"]: r for r in E.distribution_stats(df, ["y", "z"]).collect()}
    for c in ("y", "z"):
        assert shape[c]["skewness"] == pytest.approx(pdf[c].skew(), abs=1e-4)
        assert shape[c]["kurtosis"] == pytest.approx(pdf[c].kurt(), abs=1e-4)
    constant = spark.createDataFrame([(5.0,)] * 4, "k double")
    rows = E.distribution_bins(constant, "k", 4).orderBy("bin").collect()
    assert (rows[0]["range_start"], rows[3]["range_end"]) == (4.5, 5.5) and rows[2]["count"] == 4
    with pytest.raises(Exception, match="finite"):
        E.distribution_bins(spark.createDataFrame([(float("inf"),), (1.0,)], "k double"), "k").collect()
    with pytest.raises(ValueError):
        E.distribution_bins(df, "y", 101)


def test_one_row_statistics(spark):
    one = spark.createDataFrame([(25.0, 1)], "v double, id int")
    shape = E.distribution_stats(one, "v").first()
    assert shape["std"] is None and shape["skewness"] is None and shape["count"] == 1
    assert O.trim_outliers(one, "v", "zscore", 2.0).count() == 1
    assert E.pairwise_r(one, "v", "id").first()["r"] is None


def cramers_v(a, b):
    table = pd.crosstab(a.astype(str), b.astype(str)).to_numpy().astype(float)
    n = table.sum()
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / n
    gap = np.abs(table - expected)
    if table.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    chi2 = (gap**2 / expected).sum()
    r, k = table.shape
    phi = max(0, chi2 / n - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) ** 2 / (n - 1), k - (k - 1) ** 2 / (n - 1)
    return math.sqrt(phi / min(kc - 1, rc - 1)) if min(kc - 1, rc - 1) else 0.0


def test_cramers_v(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.choice(["x", "y"], 200), "b": rng.choice(["p", "q", "r"], 200)})
    pdf["c"] = np.where(rng.random(200) < 0.8, pdf["a"], "y")
    pdf["d"] = np.where(rng.random(200) < 0.1, None, pdf["b"])
    pdf["k"] = "same"
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a string, b string, c string, d string, k string")
    text = pdf.astype(object).where(pdf.notna(), "nan")
    for r in A.categorical_association(df).collect():
        a, b = r["column_a"], r["column_b"]
        want = 1.0 if a == b else cramers_v(text[a], text[b])
        assert r["v"] == pytest.approx(want, abs=1.01e-4), (a, b)


def test_value_counts_limits(spark):
    wide = spark.createDataFrame([tuple([i] * 60) for i in range(3)], [f"col_{i}" for i in range(60)])
    assert E.value_counts(wide).select("column").distinct().count() == 60
    assert E.value_counts(wide, max_columns=50).select("column").distinct().count() == 50
    assert E.value_counts_meta(wide).count() == 60
    with pytest.raises(ValueError):
        E.value_counts(wide, ["col_0"], 101)


def test_crosstab(spark, base):
    high = spark.range(60).selectExpr("id AS a", "'x' AS b")
    with pytest.raises(Exception, match="at most 50"):
        E.crosstab(high, "a", "b").collect()
    with pytest.raises(ValueError):
        E.crosstab(base, "city", "city")
    wide = {r["city"]: r for r in E.crosstab_wide(base, "city", "name").collect()}
    assert wide["NYC"]["Alice"] == 1 and wide["LA"]["Alice"] == 0


def test_missing_values(spark):
    df = spark.range(60_000).selectExpr("id AS a", "CAST(NULL AS STRING) AS b")
    rows = {r["column"]: r for r in E.missing_by_column(df).collect()}
    assert rows["b"]["null_count"] == 60_000 and rows["b"]["null_pct"] == 100.0
    assert E.co_null_pairs(df).count() == 0
    assert E.missing_by_column(df.limit(0)).first()["null_pct"] == 0.0


def test_outliers_of_people(people):
    found = {r["column"]: r for r in O.detect_outliers(people, ["age", "salary"]).collect()}
    assert found["age"]["outlier_count"] == 1 and found["salary"]["outlier_count"] == 0
    assert O.trim_outliers(people, "age").count() == 5
    assert O.impute_outliers(people, "age", "median").metrics.first()["cells_imputed"] == 1
    capped = O.cap_outliers(people, "age", 10, 90)
    assert capped.metrics.first()["cells_capped"] == 2
    for bad in (lambda: O.trim_outliers(people, "city"), lambda: O.trim_outliers(people, "age", "iqr", 11),
                lambda: O.cap_outliers(people, "age", 90, 10), lambda: O.detect_outliers(people, "age", "mad")):
        with pytest.raises(ValueError):
            bad()


def test_all_null_outliers(spark):
    df = spark.createDataFrame([(None,), (None,)], "n double")
    row = O.detect_outliers(df, "n").first()
    assert row["outlier_count"] == 0 and row["lower_bound"] is None
    assert O.trim_outliers(df, "n").count() == 2
    constant = spark.createDataFrame([(5.0,)] * 3, "n double")
    bounds = O.outlier_bounds(constant, "n", "zscore", 2.0).first()
    assert bounds["lower_bound"] == bounds["upper_bound"] == 5.0


def test_profiles(people, spark):
    rows = {r["column"]: r for r in P.inspect(people).collect()}
    assert rows["score"]["nulls"] == 1 and rows["score"]["null_pct"] == 16.7
    assert rows["age"]["is_unique"] and not rows["city"]["is_unique"]
    text = P.describe_text(people).first()
    assert (text["top"], text["freq"], text["unique"]) == ("A", 3, 3)
    empty = {r["column"]: r for r in P.describe_numeric(people.limit(0)).collect()}
    assert empty["age"]["count"] == 0 and empty["age"]["p50"] is None
    with pytest.raises(ValueError):
        P.preview(people, "age", 10_001)
    assert P.preview(people, "age", 0).count() == 6


def test_charts(spark, people):
    bars = H.bar(people, "city", "salary", "sum").orderBy("rank").collect()
    assert [(r["x"], r["y"]) for r in bars] == [("A", 220000.0), ("B", 150000.0), ("C", 80000.0)]
    empty = spark.createDataFrame([("g", None)], "x string, y double")
    assert H.bar(empty, "x", "y", "sum").first()["y"] == 0.0
    assert H.bar(empty, "x", "y", "mean").first()["y"] is None
    grouped = H.bar(people, "city", "salary", group_by="score")
    assert grouped.filter("x = 'C' AND series = '1.1'").first()["y"] == 0.0
    with pytest.raises(ValueError):
        H.bar(people, "age", "city", "sum")
    with pytest.raises(ValueError):
        H.bar(people, "city", "salary", limit=101)
    assert H.kpi(people, "salary").first()["formatted_value"] == "450.0K"
    assert H.kpi(people, "age", "mean").first()["formatted_value"] == "62.50"
    assert H.pie(people, "city", "salary", limit=1).filter("x = 'Others'").first()["y"] == 230000.0
    line = H.line(people, "age", "score", "salary").orderBy("rank").collect()
    assert line[0]["x"] == "25.0" and line[2]["y"] is None
    rows, errors = H.render_widgets(
        people,
        [{"id": "a", "chart_type": "kpi", "chart_params": {"value": "age"}}, {"id": "b", "chart_type": "radar"},
         {"id": "c", "chart_type": "report"}, {"id": "d", "chart_type": "histogram", "chart_params": {"columns": ["age"]}}],
    )
    assert list(errors) == ["b"] and rows.select("widget_id").distinct().count() == 2
