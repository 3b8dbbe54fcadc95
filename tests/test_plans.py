"""The plans must stay distributed, inside the JVM, and push their filters down."""

import pytest
from pyspark.sql import functions as F

from gristmill.operators import charts as H, nulls as N, outliers as O, rows as R
from gristmill.plans import ordering
from gristmill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas")
# The algorithms that work on blocks of bounded size in numpy.
BLOCK_QUERIES = ("q_corr_kendall", "q_knn", "q_dbscan_core", "q_silhouette", "q_silhouette_squared", "q_co_null_wide")


def plan(df):
    return df._jdf.queryExecution().toString()


def physical(df):
    return plan(df).split("== Physical Plan ==")[1]


def test_filters_reach_the_scan(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    kept = R.filter_rows(lines, "l_quantity", "gt", 10.0).select("l_orderkey", "l_quantity")
    text = physical(kept)
    assert "GreaterThan(l_quantity,10.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_trimming_reads_bounds_as_literals(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_extendedprice")
    text = physical(O.trim_outliers(lines, "l_extendedprice"))
    assert "Exchange" not in text and "Subquery" not in text


def test_charts_prune_columns(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    text = physical(H.bar(lines, "l_returnflag", "l_quantity"))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text
    assert "TakeOrderedAndProject" in text


def test_no_data_sized_single_partition(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value")
    filled = N.fill_nulls(df, "ffill", ["value"], order_by="event_id").df
    text = physical(filled)
    for part in text.split("Exchange SinglePartition")[1:]:
        below = part.strip().splitlines()[1]
        assert "HashAggregate" in below or "SortAggregate" in below or "ObjectHashAggregate" in below or "TakeOrdered" in below or "Local" in below, below
    assert f"hashpartitioning({ordering.BUCKET}" in text


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith(("q_ml", "q_load", "q_dup", "q_undo", "q_rev", "q_comm", "q_export", "q_round"))))
def test_queries_stay_in_the_jvm(spark, name):
    df = QUERIES[name](spark, SF)
    text = plan(df)
    if name not in BLOCK_QUERIES:
        assert not any(node in text for node in PYTHON_NODES)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
