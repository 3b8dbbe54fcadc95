import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.ml import dbscan as B, metrics as M, models as Z, neighbors as N, prepare as P
from gristmill.plans import blocks


def regression_data(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 3.0]
    y = 2 * x[:, 0] - x[:, 1] + 4 + rng.normal(size=n)
    pdf = pd.DataFrame({"id": range(n), "a": x[:, 0], "b": x[:, 1], "label": y})
    return x, y, spark.createDataFrame(pdf)


def fit(spark, df, algorithm, **params):
    vectors = P.assemble(df, ["a", "b"])
    settings = Z.check_params(algorithm, params)
    return Z._estimator("regression", algorithm, settings, vectors, df.count(), 0).fit(vectors)


def test_linear_family_matches_closed_forms(spark):
    x, y, df = regression_data(spark)
    xc, yc = x - x.mean(0), y - y.mean()
    ols = np.linalg.lstsq(xc, yc, rcond=None)[0]
    np.testing.assert_allclose(fit(spark, df, "linear").coefficients.toArray(), ols, rtol=1e-5)
    ridge = np.linalg.solve(xc.T @ xc + 25 * np.eye(2), xc.T @ yc)
    np.testing.assert_allclose(fit(spark, df, "ridge", alpha=25).coefficients.toArray(), ridge, rtol=1e-4)
    w, n = np.zeros(2), len(y)
    for _ in range(2000):
        for j in range(2):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / n
            w[j] = np.sign(rho) * max(abs(rho) - 0.3, 0) / (xc[:, j] @ xc[:, j] / n)
    np.testing.assert_allclose(fit(spark, df, "lasso", alpha=0.3).coefficients.toArray(), w, rtol=1e-3)


def test_logistic_gradient_vanishes(spark):
    x, y, df = regression_data(spark)
    df = df.withColumn("label", (F.col("label") > 4).cast("double"))
    t = (y > 4).astype(float)
    vectors = P.assemble(df, ["a", "b"])
    model = Z._estimator("classification", "logistic", Z.check_params("logistic", {}), vectors, len(t), 2).fit(vectors)
    w = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    np.testing.assert_allclose(w + x.T @ (p - t), 0, atol=1e-2)


def test_parameters_are_checked():
    assert Z.check_params("knn", {"n_neighbors": "7"}) == {"n_neighbors": 7}
    with pytest.raises(ValueError):
        Z.check_params("knn", {"weights": "distance"})
    with pytest.raises(ValueError):
        Z.check_params("kmeans", {"n_clusters": "many"})


def test_preparation(spark):
    df = spark.range(30).selectExpr("id", "IF(id % 3 = 0, NULL, id) AS a", "CAST(id % 2 AS STRING) AS s", "id * 2 AS y")
    assert P.prepare(df, ["a", "s"], "y").count() == 20
    with pytest.raises(ValueError):
        P.prepare(df.limit(9), ["a"], "y")
    with pytest.raises(ValueError):
        P.prepare(df, ["a", "y"], "y")
    encoded, codes = P.encode_features(df, ["s", "a"])
    assert encoded.filter("s <> id % 2").count() == 0
    with pytest.raises(Exception, match="unseen"):
        codes.transform(df.withColumn("s", F.lit("other"))).collect()


@pytest.mark.parametrize("n, size", [(10, 0.2), (997, 0.33), (2, 0.5), (1000, 0.05)])
def test_split_sizes(spark, n, size):
    train, test = P.split(spark.range(n), "id", size)
    assert test.count() == math.ceil(n * size) and train.count() == n - math.ceil(n * size)


def brute_knn(train, test, k):
    out = {}
    for i, row in test.iterrows():
        d = (train["a"] - row["a"]) ** 2 + (train["b"] - row["b"]) ** 2
        near = pd.DataFrame({"d": d, "label": train["label"]}).sort_values(["d", "label"]).head(k)
        votes = near["label"].value_counts()
        out[row["id"]] = min(votes[votes == votes.max()].index)
    return out


@pytest.mark.parametrize("k", [1, 5])
def test_knn_equals_brute_force_with_hot_copies(spark, monkeypatch, k):
    monkeypatch.setattr(N, "ROWS_PER_CELL", 10)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(300), "a": rng.integers(0, 12, 300).astype(float), "b": rng.normal(size=300).round(1)})
    pdf["label"] = rng.choice(["p", "q", "r"], 300)
    pdf.loc[pdf.index % 3 == 0, ["a", "b"]] = [3.0, 0.0]
    df = spark.createDataFrame(pdf)
    train, test = df.filter("id < 220"), df.filter("id >= 220")
    got = {r["id"]: r["prediction"] for r in N.knn_classify(train, test, ["a", "b"], "label", "id", k).collect()}
    assert got == brute_knn(pdf[pdf.id < 220], pdf[pdf.id >= 220], k)


def test_knn_with_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, 0.0, "x"), (2, 1.0, "x"), (3, 5.0, "y")], "id long, a double, label string")
    got = N.knn_classify(df, df, ["a"], "label", "id", 5).collect()
    assert {r["prediction"] for r in got} == {"x"}


def brute_dbscan(v, eps, m):
    d2 = ((v[:, None, :] - v[None, :, :]) ** 2).sum(-1)
    near = d2 <= eps * eps
    core = near.sum(1) >= m
    label = np.full(len(v), -1)
    cluster = 0
    for i in range(len(v)):
        if not core[i] or label[i] != -1:
            continue
        stack = [i]
        label[i] = cluster
        while stack:
            p = stack.pop()
            for q in np.flatnonzero(near[p]):
                if core[q] and label[q] == -1:
                    label[q] = cluster
                    stack.append(q)
        cluster += 1
    for i in range(len(v)):
        if not core[i]:
            seen = label[near[i] & core]
            label[i] = seen.min() if len(seen) else -1
    return label, core


def blobs(seed, dims):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0, 0], [4, 0, 1, 0], [0.9, 0.9, 0, 0], [2, 5, 0, 1]], dtype=float)[:, :dims]
    parts = [rng.normal(c, 0.25, size=(50, dims)) for c in centres]
    noise = rng.uniform(-3, 7, size=(40, dims))
    copies = np.repeat(centres[:1] + 2.2, 90, axis=0)
    v = np.vstack([*parts, noise, copies])
    return v[rng.permutation(len(v))]


@pytest.mark.parametrize("seed, dims, small", [(0, 2, 50_000), (1, 2, 6), (2, 3, 10), (3, 1, 4), (4, 4, 50_000)])
def test_dbscan_equals_brute_force(spark, monkeypatch, seed, dims, small):
    monkeypatch.setattr(B, "SMALL_PAIR", small)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    v = blobs(seed, dims)
    names = [f"f{i}" for i in range(dims)]
    pdf = pd.DataFrame(v, columns=names)
    pdf["id"] = range(len(pdf))
    label, core = brute_dbscan(v, 0.5, 5)
    got = B.dbscan(spark.createDataFrame(pdf), names, "id", 0.5, 5).orderBy("id").toPandas()
    assert got["core"].tolist() == core.tolist()
    assert got["cluster"].tolist() == label.tolist()


def test_dbscan_when_nothing_is_dense(spark):
    df = spark.createDataFrame([(i, float(i * 10)) for i in range(6)], "id long, a double")
    assert {r["cluster"] for r in B.dbscan(df, ["a"], "id", 1.0, 2).collect()} == {-1}
    assert {r["cluster"] for r in B.dbscan(df, ["a"], "id", 10.0, 2).collect()} == {0}


def brute_silhouette(v, label, power):
    d = ((v[:, None, :] - v[None, :, :]) ** 2).sum(-1) ** power
    s = []
    for i in range(len(v)):
        mine = label == label[i]
        if mine.sum() == 1:
            s.append(0.0)
            continue
        a = d[i][mine].sum() / (mine.sum() - 1)
        b = min(d[i][label == c].mean() for c in set(label) if c != label[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


@pytest.mark.parametrize("method, power", [("euclidean", 0.5), ("squared", 1.0)])
def test_silhouette(spark, monkeypatch, method, power):
    v = blobs(7, 2)
    label = np.where(v[:, 0] > 2, 1, 0)
    label[:3] = -1
    label[3] = 7
    pdf = pd.DataFrame({"a": v[:, 0], "b": v[:, 1], "c": label})
    row = M.silhouette(spark.createDataFrame(pdf), ["a", "b"], "c", method).first()
    assert row["n_clusters"] == 3
    assert row["silhouette"] == pytest.approx(brute_silhouette(v, label, power), abs=2e-6)
    alone = M.silhouette(spark.createDataFrame(pdf.assign(c=0)), ["a", "b"], "c", method).first()
    assert alone["n_clusters"] == 1 and alone["silhouette"] is None


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "y int, p int")
    row = M.classification_metrics(df, "y", "p").first()
    assert (row["accuracy"], row["precision"], row["recall"]) == (0.6, 0.666667, 0.666667)
    perfect = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "y double, p double")
    assert M.regression_metrics(perfect, "y", "p").first()["r2"] == 1.0


def people(spark, n=240):
    return spark.range(n).selectExpr(
        "id", "CAST(id % 60 AS DOUBLE) AS age", "IF(id % 2 = 0, 'f', 'm') AS sex",
        "IF(id % 60 > 30, 'old', 'young') AS band", "id % 60 * 2.0 + id % 2 AS score",
    )


@pytest.mark.parametrize(
    "task, algorithm, target, params",
    [("regression", "linear", "score", {}), ("classification", "random_forest", "band", {"n_estimators": 5}),
     ("classification", "knn", "band", {}), ("regression", "gradient_boost", "score", {"n_estimators": 5})],
)
def test_train_save_load_predict(spark, tmp_path, task, algorithm, target, params):
    df = people(spark)
    trained = Z.train(df, task, algorithm, ["age", "sex"], "id", target, params)
    assert (trained.train_rows, trained.test_rows) == (192, 48)
    quality = trained.metrics.first()
    assert quality["r2" if task == "regression" else "accuracy"] > 0.9
    Z.save_model(trained, str(tmp_path / "m"))
    holes = df.withColumn("age", F.when(F.col("id") % 5 > 0, F.col("age")))
    loaded = Z.load_model(spark, str(tmp_path / "m"))
    assert Z.predict(loaded, holes, "id").count() == 192
    assert tuple(Z.prediction_counts(loaded, holes).first()) == (240, 192)
    with pytest.raises(ValueError):
        Z.predict(loaded, df.drop("age"), "id")
    shares = Z.feature_importances(trained).collect()
    assert (shares == []) == (algorithm == "knn")
    if shares:
        assert sum(r["importance_pct"] for r in shares) == pytest.approx(100, abs=0.05)


def test_clustering(spark):
    v = blobs(9, 2)
    pdf = pd.DataFrame({"id": range(len(v)), "a": v[:, 0], "b": v[:, 1]})
    df = spark.createDataFrame(pdf)
    kmeans = Z.train(df, "clustering", "kmeans", ["a", "b"], "id", params={"n_clusters": 4})
    assert kmeans.metrics.first()["n_clusters"] == 4 and kmeans.metrics.first()["inertia"] > 0
    found = Z.train(df, "clustering", "dbscan", ["a", "b"], "id")
    assert found.assignments.count() == len(v)
    with pytest.raises(ValueError):
        Z.predict(found, df, "id")
    with pytest.raises(ValueError):
        Z.train(df, "clustering", "linear", ["a"], "id")
