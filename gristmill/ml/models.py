"""Model training and prediction on ``pyspark.ml``."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gristmill.functions.types import as_list, col, require_choice, require_columns
from gristmill.ml import metrics as M
from gristmill.ml.dbscan import dbscan
from gristmill.ml.neighbors import knn_classify
from gristmill.ml.prepare import (
    FEATURES,
    IS_TEST,
    TEST_SIZE,
    TextCodes,
    assemble,
    complete_rows,
    mark_test_rows,
    prepare,
)
from gristmill.plans.session import checkpoint

# Algorithms per task, default parameters, parameters a caller may set.
ALGORITHMS = {
    "regression": ("linear", "ridge", "lasso", "random_forest", "gradient_boost"),
    "classification": ("logistic", "random_forest", "gradient_boost", "knn"),
    "clustering": ("kmeans", "dbscan"),
}
DEFAULTS = {
    "linear": {},
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 1.0},
    "random_forest": {"n_estimators": 100, "max_depth": 15},
    "gradient_boost": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1},
    "logistic": {"max_iter": 1000},
    "knn": {"n_neighbors": 5},
    "kmeans": {"n_clusters": 3},
    "dbscan": {"eps": 0.5, "min_samples": 5},
}
ALLOWED = {
    "linear": {},
    "ridge": {"alpha": float},
    "lasso": {"alpha": float},
    "random_forest": {"n_estimators": int, "max_depth": int},
    "gradient_boost": {"n_estimators": int, "max_depth": int, "learning_rate": float},
    "logistic": {"max_iter": int},
    "knn": {"n_neighbors": int},
    "kmeans": {"n_clusters": int},
    "dbscan": {"eps": float, "min_samples": int},
}
SEED = 42
MAX_DEPTH = 30
MAX_CLASSES = 10_000
KMEANS_STARTS = 10
LABEL = "label"


@dataclass
class Trained:
    """What training returns; ``metrics`` is a one-row DataFrame."""

    task: str
    algorithm: str
    features: list[str]
    target: str | None
    params: dict
    metrics: DataFrame
    train_rows: int
    test_rows: int
    seconds: float
    model: Model | None = None
    codes: TextCodes | None = None
    train: DataFrame | None = None
    assignments: DataFrame | None = None
    classes: list = field(default_factory=list)


def check_params(algorithm: str, given: Mapping | None) -> dict:
    """Defaults merged with the caller's parameters; unknown keys and bad types are errors."""
    params = dict(DEFAULTS[algorithm])
    for key, value in (given or {}).items():
        if key not in ALLOWED[algorithm]:
            known = ", ".join(ALLOWED[algorithm]) or "none"
            raise ValueError(f"'{algorithm}' takes no parameter '{key}' (it takes: {known})")
        kind = ALLOWED[algorithm][key]
        try:
            params[key] = kind(value)
        except (TypeError, ValueError):
            raise ValueError(f"'{key}' of '{algorithm}' cannot be read as {kind.__name__}: {value!r}") from None
    check_depth(algorithm, params)
    return params


def check_depth(algorithm: str, params: Mapping) -> None:
    """Trees of the library are limited in depth; a deeper request is an error, not a shallower tree."""
    if algorithm in ("random_forest", "gradient_boost") and not 0 <= params["max_depth"] <= MAX_DEPTH:
        raise ValueError(f"max_depth must lie between 0 and {MAX_DEPTH}")


def linear(**options) -> LinearRegression:
    return LinearRegression(featuresCol=FEATURES, labelCol=LABEL, **options)


def ridge_penalty(train: DataFrame, alpha: float, rows: int) -> float:
    """The library divides the L2 penalty by the deviation of the target; undo that."""
    sigma = train.agg(F.stddev_samp(LABEL)).first()[0] or 0.0
    return alpha * sigma / rows


def _estimator(task: str, algorithm: str, params: dict, train: DataFrame, rows: int, classes: int):
    if algorithm == "linear":
        return linear(regParam=0.0)
    if algorithm == "ridge":
        return linear(
            regParam=ridge_penalty(train, params["alpha"], rows),
            elasticNetParam=0.0,
            standardization=False,
            solver="l-bfgs",
            maxIter=1000,
            tol=1e-12,
        )
    if algorithm == "lasso":
        return linear(
            regParam=params["alpha"], elasticNetParam=1.0, standardization=False, maxIter=1000, tol=1e-10
        )
    if algorithm == "logistic":
        return LogisticRegression(
            featuresCol=FEATURES,
            labelCol=LABEL,
            regParam=1.0 / rows,
            elasticNetParam=0.0,
            standardization=False,
            maxIter=params["max_iter"],
            tol=1e-9,
        )
    if algorithm == "random_forest":
        options = {
            "featuresCol": FEATURES,
            "labelCol": LABEL,
            "numTrees": params["n_estimators"],
            "maxDepth": params["max_depth"],
            "seed": SEED,
        }
        if task == "regression":
            return RandomForestRegressor(featureSubsetStrategy="all", **options)
        return RandomForestClassifier(featureSubsetStrategy="sqrt", **options)
    options = {
        "featuresCol": FEATURES,
        "labelCol": LABEL,
        "maxIter": params["n_estimators"],
        "maxDepth": params["max_depth"],
        "stepSize": params["learning_rate"],
        "seed": SEED,
    }
    if task == "regression":
        return GBTRegressor(**options)
    booster = GBTClassifier(**options)
    if classes <= 2:
        return booster
    return OneVsRest(classifier=booster, featuresCol=FEATURES, labelCol=LABEL)


def best_kmeans(data: DataFrame, k: int, starts: int = KMEANS_STARTS):
    """The model of lowest cost over several seeds; the vectors are kept for all of them."""
    data = data.select(FEATURES).persist()
    try:
        models = [
            KMeans(featuresCol=FEATURES, predictionCol="prediction", k=k, seed=SEED + i).fit(data)
            for i in range(starts)
        ]
        return min(models, key=lambda m: m.summary.trainingCost)
    finally:
        data.unpersist()


def encode_target(df: DataFrame, target: str, task: str) -> tuple[DataFrame, list]:
    """Add the label column: for classes their place among the sorted classes, else numbers.

    The classes come back too; more than ``MAX_CLASSES`` are an error.
    """
    if task == "regression":
        return df.withColumn(LABEL, col(target).cast("double")), []
    found = df.select(col(target).alias("c")).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"target '{target}' has more than {MAX_CLASSES} classes")
    classes = sorted(r["c"] for r in found)
    return df.withColumn(LABEL, place_of(col(target), classes, df.schema[target].dataType)), classes


def place_of(value: Column, classes: list, kind) -> Column:
    """The place of a class in the list, as a double."""
    listed = F.array(*[F.lit(c).cast(kind) for c in classes])
    return (F.array_position(listed, value) - 1).cast("double")


def class_of(place: Column, classes: list) -> Column:
    """The class at a place, in the type the target had."""
    return F.get(F.array(*[F.lit(c) for c in classes]), place.cast("int"))


def train(
    df: DataFrame,
    task: str,
    algorithm: str,
    features,
    order_by,
    target: str | None = None,
    params: Mapping | None = None,
    test_size: float = TEST_SIZE,
    silhouette_method: str = "squared",
    pos_label=None,
) -> Trained:
    """Null removal, encoding, split, fit and evaluation.

    Clusterings are scored by the silhouette on squared distances, which is linear in the rows
    and reported as ``silhouette_squared``; ``silhouette_method="euclidean"`` asks for the exact
    one, which compares all points. Classes may be any values: they are coded by their place in
    sorted order, kept in ``classes``, and predictions come back as the classes themselves.
    ``pos_label`` is the class whose measures two-class targets report (the greater one).
    """
    started = time.monotonic()
    require_choice(task, ALGORITHMS, "task")
    require_choice(algorithm, ALGORITHMS[task], "algorithm")
    settings = check_params(algorithm, params)
    names, keys = as_list(features), require_columns(df, as_list(order_by))
    if task != "clustering" and target is None:
        raise ValueError("supervised training needs a target column")
    if not keys:
        raise ValueError("the split follows the row key: pass order_by")
    rows = prepare(df, names, None if task == "clustering" else target)
    ids = [f"__id{i}" for i in range(len(keys))]
    used = [*names, *([target] if task != "clustering" else [])]
    rows = rows.select(*[col(k).alias(i) for k, i in zip(keys, ids)], *[col(c) for c in used])
    codes = TextCodes.fit(rows, names)
    if task == "clustering":
        rows = codes.transform(rows)
        return _train_clusters(rows, algorithm, names, ids, settings, codes, started, silhouette_method)
    labelled, found = encode_target(rows, target, task)
    coded = codes.transform(labelled)
    # The split is written once; fitting then scans plain columns in every pass.
    data = checkpoint(mark_test_rows(checkpoint(coded), ids, test_size))
    train_rows = data.filter(~F.col(IS_TEST)).drop(IS_TEST)
    test_rows = data.filter(IS_TEST).drop(IS_TEST)
    counts = train_rows.count(), test_rows.count()
    result = Trained(
        task, algorithm, names, target, settings, None, *counts, 0.0, codes=codes, classes=found
    )
    if algorithm == "knn":
        result.train = train_rows
        scored = test_rows.join(
            knn_classify(train_rows, test_rows, names, LABEL, ids, settings["n_neighbors"]), ids
        )
    else:
        vectors = assemble(train_rows, names)
        estimator = _estimator(task, algorithm, settings, vectors, counts[0], len(found))
        result.model = estimator.fit(vectors)
        scored = result.model.transform(assemble(test_rows, names))
    scored = checkpoint(scored.select(LABEL, "prediction"))
    if task == "regression":
        result.metrics = M.regression_metrics(scored, LABEL, "prediction")
    else:
        positive = 1.0 if pos_label is None else float(found.index(pos_label))
        result.metrics = M.classification_metrics(scored, LABEL, "prediction", positive)
    result.seconds = round(time.monotonic() - started, 3)
    return result


def _train_clusters(rows, algorithm, names, ids, settings, codes, started, method) -> Trained:
    data = checkpoint(rows)
    n = data.count()
    result = Trained("clustering", algorithm, names, None, settings, None, n, 0, 0.0, codes=codes)
    if algorithm == "kmeans":
        vectors = assemble(data, names)
        result.model = best_kmeans(vectors, settings["n_clusters"])
        clusters = result.model.transform(vectors).select(
            *ids, *[col(c) for c in names], F.col("prediction").alias("cluster")
        )
        inertia = round(float(result.model.summary.trainingCost), 4)
    else:
        found = dbscan(data, names, ids, settings["eps"], settings["min_samples"]).drop("core")
        clusters, inertia = data.join(found, ids), None
    clusters = checkpoint(clusters)
    result.assignments = clusters.select(*ids, "cluster")
    scores = M.silhouette(clusters, names, "cluster", method)
    if method == "squared":
        scores = scores.withColumnRenamed("silhouette", "silhouette_squared")
    result.metrics = scores if inertia is None else scores.withColumn("inertia", F.lit(inertia))
    result.seconds = round(time.monotonic() - started, 3)
    return result


def predict(trained: Trained, df: DataFrame, order_by) -> DataFrame:
    """``(keys, prediction)`` for the rows with every feature present: 6 digits, or the class itself."""
    missing = [f for f in trained.features if f not in df.columns]
    if missing:
        raise ValueError(f"feature columns are missing: {missing}")
    if trained.algorithm == "dbscan":
        raise ValueError("a dbscan model cannot predict new rows")
    keys = require_columns(df, as_list(order_by))
    ids = [f"__id{i}" for i in range(len(keys))]
    rows = complete_rows(df, trained.features).select(
        *[col(k).alias(i) for k, i in zip(keys, ids)], *[col(f) for f in trained.features]
    )
    rows = trained.codes.transform(rows) if trained.codes else rows
    if trained.algorithm == "knn":
        out = knn_classify(
            trained.train, rows, trained.features, LABEL, ids, trained.params["n_neighbors"]
        )
    else:
        out = trained.model.transform(assemble(rows, trained.features))
    value = F.col("prediction").cast("double")
    if trained.task == "regression":
        value = F.round(value, 6)
    else:
        value = class_of(value, trained.classes) if trained.classes else value.cast("long")
    return out.select(*[F.col(i).alias(k) for i, k in zip(ids, keys)], value.alias("prediction"))


def prediction_counts(trained: Trained, df: DataFrame) -> DataFrame:
    """One row: rows in the table and rows that can be predicted."""
    present = F.lit(True)
    for f in trained.features:
        present = present & col(f).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(present).alias("predicted_rows")
    )


def feature_importances(trained: Trained) -> DataFrame:
    """``(feature, importance, importance_pct)``, largest first; empty when there are none."""
    spark = SparkSession.active()
    model, schema = trained.model, "feature string, importance double, importance_pct double"
    values = None
    if model is not None and hasattr(model, "featureImportances"):
        values = list(model.featureImportances.toArray())
    elif model is not None and hasattr(model, "coefficientMatrix"):
        matrix = abs(model.coefficientMatrix.toArray())
        values = list(matrix.mean(axis=0))
    elif model is not None and hasattr(model, "coefficients"):
        values = list(abs(model.coefficients.toArray()))
    elif model is not None and hasattr(model, "models"):
        parts = [m.featureImportances.toArray() for m in model.models]
        values = list(sum(parts) / len(parts))
    if values is None:
        return spark.createDataFrame([], schema)
    total = float(sum(values))
    rows = [
        (f, round(float(v), 6), round(float(v) / total * 100, 2) if total > 0 else 0.0)
        for f, v in zip(trained.features, values)
    ]
    rows.sort(key=lambda r: -r[1])
    return spark.createDataFrame(rows, schema)


def save_model(trained: Trained, path: str) -> None:
    """A folder with the model (or the knn training rows), the text codes and the settings."""
    spark = SparkSession.active()
    if trained.algorithm == "dbscan":
        raise ValueError("a dbscan model cannot predict new rows")
    if trained.algorithm == "knn":
        trained.train.write.mode("overwrite").parquet(f"{path}/train")
    else:
        PipelineModel([trained.model]).write().overwrite().save(f"{path}/model")
    coded = trained.codes.columns if trained.codes else []
    if coded:
        trained.codes.save(f"{path}/codes")
    settings = {
        "task": trained.task,
        "algorithm": trained.algorithm,
        "features": trained.features,
        "target": trained.target,
        "params": trained.params,
        "coded": coded,
        "classes": trained.classes,
        "train_rows": trained.train_rows,
        "test_rows": trained.test_rows,
    }
    spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/settings")
    trained.metrics.coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")


def load_model(spark: SparkSession, path: str) -> Trained:
    settings = json.loads(spark.read.schema("settings string").json(f"{path}/settings").first()[0])
    codes = TextCodes.load(spark, f"{path}/codes", settings["coded"])
    trained = Trained(
        settings["task"],
        settings["algorithm"],
        settings["features"],
        settings["target"],
        settings["params"],
        spark.read.parquet(f"{path}/metrics"),
        settings["train_rows"],
        settings["test_rows"],
        0.0,
        codes=codes,
        classes=settings["classes"],
    )
    if trained.algorithm == "knn":
        trained.train = spark.read.parquet(f"{path}/train")
    else:
        trained.model = PipelineModel.load(f"{path}/model").stages[0]
    return trained
