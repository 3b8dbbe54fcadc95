"""Sources, sinks, versioned datasets and their activity log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gristmill.operators import nulls as N, rows as R
from gristmill.plans.session import shared_folder
from gristmill.queries.registry import events_with_nulls, query, table
from gristmill.sources import datasets as D, files as S

_CUSTOMER = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _place(spark) -> str:
    """A fresh folder that all executors share."""
    return f"{shared_folder(spark)}/gristmill/{uuid.uuid4().hex}"


def _customers(spark, sf):
    return table(spark, sf, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


def _round_trip(spark, sf, fmt, read):
    path = f"{_place(spark)}/customer.{fmt}"
    S.save(_customers(spark, sf), path, fmt)
    return read(path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer"""
)
def q_load_csv(spark, sf):
    path = f"{_place(spark)}/customer.csv"
    dirty = table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE c_name END AS c_name",
        "CASE WHEN c_custkey % 4 = 0 THEN 'NA' ELSE CAST(c_acctbal AS STRING) END AS c_acctbal",
    )
    S.save(dirty, path)
    return S.load(spark, path)


@query(_CUSTOMER)
def q_load_json(spark, sf):
    return _round_trip(spark, sf, "json", lambda p: S.load(spark, p))


@query(_CUSTOMER)
def q_roundtrip_parquet(spark, sf):
    return _round_trip(spark, sf, "parquet", lambda p: S.load(spark, p))


@query(_CUSTOMER)
def q_export_json(spark, sf):
    dataset = D.Dataset.create(spark, _place(spark), "customer", _customers(spark, sf))
    path = dataset.export(f"{dataset.folder}/out/customer.json", "json")
    return S.load(spark, path, "json").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(_CUSTOMER)
def q_duplicate(spark, sf):
    dataset = D.Dataset.create(spark, _place(spark), "customer", _customers(spark, sf))
    return dataset.duplicate(fmt="csv").read()


_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


@query(
    " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS file, 'parquet' AS ext, true AS ok, count(*) > 0 AS filled FROM {t}" for t in _TABLES
    )
)
def q_validate_files(spark, sf):
    """The files of the test tables themselves."""
    name = F.element_at(F.split("path", "/"), -1)
    return S.validate_files(spark, sf).select(name.alias("file"), "ext", "ok", (F.col("length") > 0).alias("filled"))


def _history(spark, sf):
    """Upload, filter, a fill that changes nothing, a drop of nulls, two undos."""
    dataset = D.Dataset.create(spark, _place(spark), "events", events_with_nulls(spark, sf))
    kept = R.filter_rows(dataset.read(), "event_type", "notnull")
    dataset.commit(kept, "FILTER_ROWS", {"column": "event_type"})
    unchanged = N.fill_nulls(dataset.read(), "constant", "event_type", "none")
    dataset.commit(unchanged, "FILL_NULLS", counter="cells_filled")
    dataset.commit(N.drop_nulls(dataset.read()), "DROP_NULLS", {"how": "any"})
    dataset.undo()
    dataset.undo()
    return dataset


@query(
    """SELECT * FROM (VALUES (0, 'UPLOAD'), (1, 'FILTER_ROWS'), (2, 'DROP_NULLS'), (3, 'REVERT'), (4, 'REVERT')) t(version, action)
WHERE (SELECT count(*) FROM events) > 0"""
)
def q_commit_manifest(spark, sf):
    return _history(spark, sf).manifest().select("version", "action")


@query(
    """SELECT event_id, CASE WHEN event_id % 14 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events"""
)
def q_undo(spark, sf):
    return _history(spark, sf).read()


@query(
    """SELECT event_id, CASE WHEN event_id % 14 = 0 THEN NULL ELSE user_id END AS user_id, event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events
WHERE event_id % 13 <> 0 AND event_id % 7 <> 0"""
)
def q_revert(spark, sf):
    dataset = _history(spark, sf)
    dataset.revert(2)
    return dataset.read()


# The events table stands in for a long log: every event is one logged action.
_LOG_SELECT = """event_id AS version, CAST(user_id % 10 AS {text}) AS dataset,
  CASE event_type WHEN 'click' THEN 'CAST' WHEN 'view' THEN 'PREVIEW' WHEN 'error' THEN 'DROP_NULLS'
    WHEN 'signup' THEN 'UPLOAD' ELSE 'EXPORT' END AS action, ts"""
_LOG = f"log AS (SELECT {_LOG_SELECT.format(text='VARCHAR')} FROM events)"


def _log(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("gristmill_log_events")
    return spark.sql(f"SELECT {_LOG_SELECT.format(text='STRING')} FROM gristmill_log_events")


@query(
    f"""WITH {_LOG} SELECT version, dataset, action FROM log WHERE dataset = '3' ORDER BY ts DESC, version DESC LIMIT 20 OFFSET 40"""
)
def q_activity_log(spark, sf):
    return D.activity_log(_log(spark, sf), "3", offset=40).drop("ts")


@query(
    f"""WITH {_LOG}, d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-27', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day),
c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS actions, count(*) FILTER (action IN ('CAST', 'DROP_NULLS')) AS analyses
      FROM log GROUP BY 1)
SELECT d.day, coalesce(actions, 0) AS actions, coalesce(analyses, 0) AS analyses FROM d LEFT JOIN c USING (day)"""
)
def q_activity_rollup(spark, sf):
    return D.activity_rollup(_log(spark, sf), "2024-02-02")


@query(
    f"""WITH {_LOG}
SELECT count(*) AS total_actions, count(*) FILTER (action IN ('CAST', 'DROP_NULLS')) AS total_analyses,
  count(*) FILTER (ts >= DATE '2024-01-23') AS recent_actions,
  count(*) FILTER (ts >= DATE '2024-01-23' AND action IN ('CAST', 'DROP_NULLS')) AS recent_analyses FROM log"""
)
def q_activity_totals(spark, sf):
    return D.activity_totals(_log(spark, sf), "2024-01-30")


@query(f"WITH {_LOG} SELECT version, dataset, action FROM log ORDER BY ts DESC LIMIT 5")
def q_recent_activity(spark, sf):
    return D.recent_activity(_log(spark, sf)).drop("ts")
