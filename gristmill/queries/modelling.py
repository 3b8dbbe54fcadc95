"""Model preparation, training, evaluation and prediction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gristmill.ml import dbscan as B, metrics as M, models as Z, neighbors as K, prepare as P
from gristmill.plans.session import shared_folder
from gristmill.queries.registry import query, register, rounded, table

_ORDERS = """o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_totalprice FROM orders)"""


def _orders(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS o_custkey",
        "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
        "o_totalprice",
    )


@query(f"WITH {_ORDERS} SELECT * FROM o WHERE o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL")
def q_ml_prepare(spark, sf):
    return P.prepare(_orders(spark, sf), ["o_custkey", "o_orderpriority"], "o_totalprice")


@query(
    """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus,
  dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders"""
)
def q_ml_encode_features(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return P.encode_features(orders, ["o_orderstatus", "o_orderpriority"])[0]


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':42'))
  <= ceil((SELECT count(*) FROM orders) * 0.2) AS is_test FROM orders"""
)
def q_ml_split(spark, sf):
    return P.mark_test_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem"""
)
def q_ols_simple(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    model = Z.linear(regParam=0.0, solver="normal").fit(P.assemble(lines, ["l_quantity"]))
    return spark.createDataFrame(
        [(round(float(model.coefficients[0]), 4), round(float(model.intercept), 2))],
        "slope double, intercept double",
    )


@query(
    """WITH p AS (SELECT l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem)
SELECT round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(avg(abs(y - p)), 6) AS mae,
  round(avg((y - p) * (y - p)), 2) AS mse, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM p"""
)
def q_regression_metrics(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p")
    )
    return M.regression_metrics(lines, "y", "p").withColumn("mse", F.round("mse", 2))


@query(
    """WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (quality = 1) AS chosen,
  count(*) FILTER (toxic = 1) AS support, count(*) FILTER (toxic = quality) AS hits, count(*) AS n FROM labels)
SELECT round(hits / n, 6) AS accuracy, round(coalesce(tp / nullif(chosen, 0), 0), 6) AS "precision",
  round(coalesce(tp / nullif(support, 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(chosen + support, 0), 0), 6) AS f1 FROM c"""
)
def q_classification_metrics_binary(spark, sf):
    return M.classification_metrics(table(spark, sf, "labels"), "toxic", "quality")


_RULE = "CASE WHEN o_totalprice > 300000 THEN 'P' WHEN o_totalprice > 100000 THEN 'O' ELSE 'F' END"


@query(
    f"""WITH t AS (SELECT o_orderstatus AS y, {_RULE} AS p FROM orders),
k AS (SELECT y AS label FROM t UNION SELECT p FROM t),
m AS (SELECT label, (SELECT count(*) FROM t WHERE y = label) AS support, (SELECT count(*) FROM t WHERE p = label) AS chosen,
             (SELECT count(*) FROM t WHERE y = label AND p = label) AS hits FROM k),
s AS (SELECT *, coalesce(hits / nullif(chosen, 0), 0) AS pr, coalesce(hits / nullif(support, 0), 0) AS re,
             coalesce(2.0 * hits / nullif(chosen + support, 0), 0) AS f FROM m)
SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS "precision",
  round(sum(re * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(support), 6) AS f1 FROM s"""
)
def q_classification_metrics_weighted(spark, sf):
    orders = table(spark, sf, "orders").selectExpr("o_orderstatus AS y", f"{_RULE} AS p")
    return M.classification_metrics(orders, "y", "p")


# --- neighbours, density, silhouette ---------------------------------------------------


def _placed_parts(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey", "CAST(p_size AS DOUBLE) AS size", "p_retailprice / 10 AS price", "p_type"
    )


_PLACED = "p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice / 10 AS price, p_type FROM part)"


@query(
    f"""WITH {_PLACED}, m AS (
  SELECT *, row_number() OVER (ORDER BY md5(p_partkey || ':42')) <= ceil((SELECT count(*) FROM part) * 0.2) AS test FROM p),
d AS (SELECT a.p_partkey, b.p_type, row_number() OVER (PARTITION BY a.p_partkey
        ORDER BY (a.size - b.size) * (a.size - b.size) + (a.price - b.price) * (a.price - b.price), b.p_type) AS n
      FROM (SELECT * FROM m WHERE test) a, (SELECT * FROM m WHERE NOT test) b),
v AS (SELECT p_partkey, p_type, count(*) AS votes FROM d WHERE n <= 5 GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY votes DESC, p_type) AS k FROM v)
SELECT p_partkey, p_type AS prediction FROM w WHERE k = 1"""
)
def q_knn(spark, sf):
    train, test = P.split(_placed_parts(spark, sf), "p_partkey")
    return K.knn_classify(train, test, ["size", "price"], "p_type", "p_partkey")


@query(
    f"""WITH {_PLACED}
SELECT a.p_partkey, count(*) >= 12 AS core FROM p a, p b
WHERE (a.size - b.size) * (a.size - b.size) + (a.price - b.price) * (a.price - b.price) <= 2.25
GROUP BY a.p_partkey"""
)
def q_dbscan_core(spark, sf):
    return B.core_flags(_placed_parts(spark, sf), ["size", "price"], "p_partkey", 1.5, 12)


@query(
    f"""WITH RECURSIVE {_PLACED},
near AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a, p b
         WHERE (a.size - b.size) * (a.size - b.size) + (a.price - b.price) * (a.price - b.price) <= 2.25),
core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 12),
edges AS (SELECT n.a, n.b FROM near n SEMI JOIN core ON core.a = n.a WHERE n.b IN (SELECT a FROM core)),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
root AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
named AS (SELECT a, dense_rank() OVER (ORDER BY low) - 1 AS label FROM root),
border AS (SELECT n.a, min(named.label) AS label FROM near n JOIN named ON named.a = n.b WHERE n.a NOT IN (SELECT a FROM core) GROUP BY n.a)
SELECT p_partkey, coalesce(named.label, border.label, -1) AS cluster, named.a IS NOT NULL AS core
FROM p LEFT JOIN named ON named.a = p_partkey LEFT JOIN border ON border.a = p_partkey"""
)
def q_ml_train_dbscan(spark, sf):
    return B.dbscan(_placed_parts(spark, sf), ["size", "price"], "p_partkey", 1.5, 12)


_SILHOUETTE = f"""WITH {_PLACED}, c AS (SELECT *, CASE WHEN size < 15 THEN 0 WHEN price < 95 THEN 1 ELSE 2 END AS label FROM p),
s AS (SELECT a.p_partkey, a.label AS own, b.label, sum({{distance}}) AS total, count(*) AS n FROM c a, c b GROUP BY 1, 2, 3),
m AS (SELECT p_partkey, max(CASE WHEN own = label THEN total / nullif(n - 1, 0) END) AS a,
             min(CASE WHEN own <> label THEN total / n END) AS b FROM s GROUP BY 1)
SELECT (SELECT count(DISTINCT label) FROM c) AS n_clusters,
  round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m"""
_GAP = "(a.size - b.size) * (a.size - b.size) + (a.price - b.price) * (a.price - b.price)"


def _clustered(spark, sf):
    return _placed_parts(spark, sf).selectExpr(
        "size", "price", "CASE WHEN size < 15 THEN 0 WHEN price < 95 THEN 1 ELSE 2 END AS label"
    )


@query(_SILHOUETTE.format(distance=f"sqrt({_GAP})"))
def q_silhouette(spark, sf):
    return M.silhouette(_clustered(spark, sf), ["size", "price"], "label")


@query(_SILHOUETTE.format(distance=_GAP))
def q_silhouette_squared(spark, sf):
    return M.silhouette(_clustered(spark, sf), ["size", "price"], "label", "squared")


# --- training --------------------------------------------------------------------------


def _line_features(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "o_totalprice / 1000 AS price",
        "CAST(o_custkey AS DOUBLE) / 100 AS customer",
        "o_orderpriority",
        "o_totalprice / 500 + CAST(o_custkey AS DOUBLE) / 50 + pmod(o_orderkey, 7) AS target",
        "CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS size",
        "CASE WHEN o_totalprice > 350000 THEN 'a' WHEN o_totalprice > 150000 THEN 'b' ELSE 'c' END AS band",
    )


_FEATURES = ["price", "customer", "o_orderpriority"]


def _trained(spark, sf, task, algorithm, target=None, features=None, **params):
    return Z.train(
        _line_features(spark, sf), task, algorithm, features or _FEATURES, "o_orderkey", target, params
    )


def _test_rows(table: str, key: str) -> str:
    """The rows of ``table`` with the flag of the split."""
    return (
        f"SELECT *, row_number() OVER (ORDER BY md5({key} || ':42')) <= ceil((SELECT count(*) FROM {table}) * 0.2) AS test FROM {table}"
    )


# Two features that are uncorrelated enough for closed forms, and a target that is exact in them
# for ordinary least squares: 2 * price + 2 * customer (+ a known remainder for the others).
_LINES = """o AS (SELECT o_orderkey, o_totalprice / 1000 AS price, CAST(o_custkey AS DOUBLE) / 100 AS customer, o_orderpriority,
  o_totalprice / 500 + CAST(o_custkey AS DOUBLE) / 50 + o_orderkey % 7 AS target,
  CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS size,
  CASE WHEN o_totalprice > 350000 THEN 'a' WHEN o_totalprice > 150000 THEN 'b' ELSE 'c' END AS band FROM orders)"""

# Normal equations of two features on the training rows; {ridge} is added to the diagonal.
_NORMAL = """m AS ({split}),
c AS (SELECT avg(price) AS mp, avg(customer) AS mc, avg(target) AS mt FROM m WHERE NOT test),
n AS (SELECT sum((price - mp) * (price - mp)) + {ridge} AS pp, sum((price - mp) * (customer - mc)) AS pc,
             sum((customer - mc) * (customer - mc)) + {ridge} AS cc, sum((price - mp) * (target - mt)) AS pt,
             sum((customer - mc) * (target - mt)) AS ct FROM m, c WHERE NOT test),
w AS (SELECT (pt * cc - ct * pc) / (pp * cc - pc * pc) AS wp, (ct * pp - pt * pc) / (pp * cc - pc * pc) AS wc FROM n)"""
_PREDICTED = "SELECT o_orderkey, target AS y, mt + wp * (price - mp) + wc * (customer - mc) AS p, test FROM m, c, w"
_REGRESSION = """SELECT round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2, round(avg(abs(y - p)), 4) AS mae,
  round(avg((y - p) * (y - p)), 4) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse FROM f WHERE test"""


def _closed_form(ridge: float) -> str:
    normal = _NORMAL.format(split=_test_rows("o", "o_orderkey"), ridge=ridge)
    return f"WITH {_LINES}, {normal}, f AS ({_PREDICTED}) {_REGRESSION}"


_TWO = ["price", "customer"]


@query(_closed_form(0.0))
def q_ml_train_linear(spark, sf):
    return rounded(_trained(spark, sf, "regression", "linear", "target", _TWO).metrics)


@query(_closed_form(2.0))
def q_ml_train_ridge(spark, sf):
    return rounded(_trained(spark, sf, "regression", "ridge", "target", _TWO, alpha=2.0).metrics)


# One feature: the coefficient is the least-squares one with its covariance drawn in by alpha.
@query(
    f"""WITH {_LINES}, m AS ({_test_rows("o", "o_orderkey")}),
c AS (SELECT avg(price) AS mp, avg(target) AS mt, var_pop(price) AS v, covar_pop(price, target) AS k FROM m WHERE NOT test),
w AS (SELECT sign(k) * greatest(abs(k) - 0.5, 0) / v AS wp FROM c),
f AS (SELECT target AS y, mt + wp * (price - mp) AS p, test FROM m, c, w) {_REGRESSION}"""
)
def q_ml_train_lasso(spark, sf):
    return rounded(_trained(spark, sf, "regression", "lasso", "target", ["price"], alpha=0.5).metrics)


# Classes that lie far apart, so that every sound model tells the test rows apart without error.
def _apart(spark, sf, *labels):
    """``x`` is 1,000 apart between classes and ``noise`` says nothing; labels by the key."""
    cases = " ".join(f"WHEN {i} THEN {label}" for i, label in enumerate(labels))
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", f"pmod(o_orderkey, {len(labels)}) * 1000.0D + pmod(o_custkey, 10) AS x",
        "CAST(pmod(o_custkey, 7) AS DOUBLE) AS noise", f"CASE pmod(o_orderkey, {len(labels)}) {cases} END AS label",
    )


_PERFECT = 'SELECT 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS "precision", 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM orders LIMIT 1'


def _classified(spark, sf, algorithm, labels, **params):
    return Z.train(_apart(spark, sf, *labels), "classification", algorithm, ["x", "noise"], "o_orderkey", "label", params)


for _name, _algorithm, _labels, _params in (
    ("rf", "random_forest", ("'big'", "'small'"), {"n_estimators": 10, "max_depth": 5}),
    ("gbt", "gradient_boost", ("'big'", "'small'"), {"n_estimators": 5}),
    ("gbt_multiclass", "gradient_boost", ("'a'", "'b'", "'c'"), {"n_estimators": 3}),
    ("gbt_one_two", "gradient_boost", ("1", "2"), {"n_estimators": 3}),
    ("logistic", "logistic", ("'a'", "'b'", "'c'"), {"max_iter": 200}),
    ("labels_minus", "logistic", ("-1", "1"), {"max_iter": 200}),
    ("rf_thousand", "random_forest", ("1", "1000"), {"n_estimators": 10, "max_depth": 5}),
    ("knn", "knn", ("'big'", "'small'"), {}),
):
    register(
        f"q_ml_train_{_name}",
        lambda s, d, a=_algorithm, y=_labels, p=_params: _classified(s, d, a, y, **p).metrics,
        _PERFECT,
    )

# A target that is constant within each of three far groups: trees fit it without error.
for _name, _algorithm, _params, _digits in (
    ("rf_regression", "random_forest", {"n_estimators": 10, "max_depth": 5}, 6),
    ("gbt_regression", "gradient_boost", {"n_estimators": 5}, 6),
):
    register(
        f"q_ml_train_{_name}",
        lambda s, d, a=_algorithm, p=_params: Z.train(
            _apart(s, d, "10.0D", "20.0D", "40.0D"), "regression", a, ["x"], "o_orderkey", "label", p
        ).metrics,
        "SELECT 1.0::DOUBLE AS r2, 0.0::DOUBLE AS mae, 0.0::DOUBLE AS mse, 0.0::DOUBLE AS rmse FROM orders LIMIT 1",
    )


@query(
    """WITH g AS (SELECT o_orderkey % 3 AS k, o_custkey % 10 AS x, o_custkey % 7 AS y FROM orders),
m AS (SELECT k, avg(x) AS mx, avg(y) AS my FROM g GROUP BY k),
i AS (SELECT sum((x - mx) * (x - mx) + (y - my) * (y - my)) AS inertia FROM g JOIN m USING (k))
SELECT 3::BIGINT AS n_clusters, round(inertia, 2) AS inertia, true AS apart FROM i"""
)
def q_ml_train_kmeans(spark, sf):
    """Three far groups: the clusters are the groups, whatever the start."""
    found = Z.train(_apart(spark, sf, "1", "2", "3"), "clustering", "kmeans", ["x", "noise"], "o_orderkey")
    return found.metrics.select(
        "n_clusters", F.round("inertia", 2).alias("inertia"), (F.col("silhouette_squared") > 0.99).alias("apart")
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END::BIGINT AS prediction FROM orders")
def q_ml_predict_classes(spark, sf):
    """Predictions of a saved and loaded model are the classes themselves."""
    trained = _classified(spark, sf, "logistic", ("-1L", "1L"), max_iter=200)
    path = f"{shared_folder(spark)}/gristmill/{uuid.uuid4().hex}"
    Z.save_model(trained, path)
    rows = _apart(spark, sf, "-1L", "1L").drop("label")
    return Z.predict(Z.load_model(spark, path), rows, "o_orderkey").withColumn("prediction", F.col("prediction").cast("long"))


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS label FROM part")
def q_ml_target_codes(spark, sf):
    """Every target class is coded by its place in sorted order."""
    coded, _ = Z.encode_target(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "classification")
    return coded.select("p_partkey", "label")


@query(
    f"""WITH {_LINES}, {_NORMAL.format(split=_test_rows("o", "o_orderkey"), ridge=0.0)}, f AS ({_PREDICTED})
SELECT o_orderkey, floor(round(p, 6) * 100 + 0.5) / 100 AS prediction FROM f"""
)
def q_ml_predict(spark, sf):
    trained = _trained(spark, sf, "regression", "linear", "target", _TWO)
    path = f"{shared_folder(spark)}/gristmill/{uuid.uuid4().hex}"
    Z.save_model(trained, path)
    found = Z.predict(Z.load_model(spark, path), _line_features(spark, sf), "o_orderkey")
    return found.withColumn("prediction", F.floor(F.col("prediction") * 100 + 0.5) / 100)


@query(
    """SELECT * FROM (VALUES ('x', 1.0::DOUBLE, 100.0::DOUBLE), ('constant', 0.0::DOUBLE, 0.0::DOUBLE)) v(feature, importance, importance_pct)
WHERE EXISTS (SELECT 1 FROM orders)"""
)
def q_ml_feature_importances(spark, sf):
    """One feature tells all, the other is the same in every row."""
    rows = _apart(spark, sf, "'big'", "'small'").withColumn("constant", F.lit(1.0))
    return Z.feature_importances(
        Z.train(rows, "classification", "random_forest", ["x", "constant"], "o_orderkey", "label", {"n_estimators": 10, "max_depth": 5})
    )
