"""Registered queries: a Spark builder and, where SQL can express it, an independent oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gristmill.functions.types import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query '{name}' is registered twice")
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def query(sql: str | None = None):
    """Register a builder under its function name."""

    def wrap(build):
        register(build.__name__, build, sql)
        return build

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round the double columns, as the oracles do."""
    return df.select(
        *[
            F.round(col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else col(f.name)
            for f in df.schema
        ]
    )


def events_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Events with missing values injected by key; ``EVENTS`` is the same in SQL."""
    return table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 14 = 0 THEN NULL ELSE user_id END AS user_id",
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value",
    )


EVENTS = """ev AS (
  SELECT event_id,
         CASE WHEN event_id % 14 = 0 THEN NULL ELSE user_id END AS user_id,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
  FROM events)"""


def bad_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with wrong and missing totals; ``BAD_LINES`` is the same in SQL."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 50 = 1 THEN l_quantity * l_extendedprice * 1.5 "
        "ELSE l_quantity * l_extendedprice END AS prod",
        "CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_discount = 0 THEN NULL "
        "ELSE l_extendedprice / nullif(l_discount, 0) END AS quot",
        "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity + l_extendedprice END AS total",
        "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity - l_extendedprice END AS gap",
    )


BAD_LINES = """li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
         CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 50 = 1 THEN l_quantity * l_extendedprice * 1.5
              ELSE l_quantity * l_extendedprice END AS prod,
         CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_discount = 0 THEN NULL
              ELSE l_extendedprice / nullif(l_discount, 0) END AS quot,
         CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity + l_extendedprice END AS total,
         CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity - l_extendedprice END AS gap
  FROM lineitem)"""
