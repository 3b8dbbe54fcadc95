"""Filters, duplicates, nulls, casts, column edits, formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gristmill.operators import columns as C, fitted as FT, formula as X, nulls as N, rows as R
from gristmill.queries.registry import (
    BAD_LINES,
    EVENTS,
    bad_lines,
    events_with_nulls,
    query,
    register,
    rounded,
    table,
)

# --- filters ---------------------------------------------------------------------------

for _op, _column, _value, _where in (
    ("eq", "event_type", "click", "event_type = 'click'"),
    ("ne", "event_type", "click", "event_type IS DISTINCT FROM 'click'"),
    ("gt", "value", 50.0, "value > 50"),
    ("gte", "value", 50.0, "value >= 50"),
    ("lt", "value", 50.0, "value < 50"),
    ("lte", "value", 50.0, "value <= 50"),
    ("isnull", "value", None, "value IS NULL"),
    ("notnull", "value", None, "value IS NOT NULL"),
):
    register(
        f"q_filter_{_op}",
        lambda s, d, op=_op, c=_column, v=_value: R.filter_rows(events_with_nulls(s, d), c, op, v),
        f"WITH {EVENTS} SELECT * FROM ev WHERE {_where}",
    )


def _parts(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_name END AS p_name"
    )


_PARTS = (
    "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_name END AS p_name FROM part) "
)


@query(_PARTS + "SELECT * FROM p WHERE contains(p_name, 'blue')")
def q_filter_contains(spark, sf):
    return R.filter_rows(_parts(spark, sf), "p_name", "contains", "blue")


@query(_PARTS + "SELECT * FROM p WHERE p_name IS NULL OR NOT contains(p_name, 'blue')")
def q_filter_not_contains(spark, sf):
    return R.filter_rows(_parts(spark, sf), "p_name", "not_contains", "blue")


# --- duplicates ------------------------------------------------------------------------


def _orders_twice(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )
    first = orders.withColumn("copy", F.lit(0).cast("long"))
    again = orders.filter("o_orderkey % 10 = 0").withColumn("copy", F.lit(1).cast("long"))
    return first.unionByName(again)


_TWICE = """WITH twice AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(0 AS BIGINT) AS copy FROM orders
  UNION ALL
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(1 AS BIGINT) FROM orders
  WHERE o_orderkey % 10 = 0) """
_PLAIN = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@query(_TWICE + f"SELECT {_PLAIN}, min(copy) AS copy FROM twice GROUP BY {_PLAIN}")
def q_dedup_all_first(spark, sf):
    return R.drop_duplicates(_orders_twice(spark, sf), "all_first", order_by="copy")


@query(_TWICE + f"SELECT {_PLAIN}, max(copy) AS copy FROM twice GROUP BY {_PLAIN}")
def q_dedup_all_last(spark, sf):
    return R.drop_duplicates(_orders_twice(spark, sf), "all_last", order_by="copy")


_NUMBERED = (
    _TWICE
    + "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, copy FROM ("
    "SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY {order}) AS n FROM twice) "
    "WHERE n = 1"
)


@query(_NUMBERED.format(order="o_orderkey, copy"))
def q_dedup_subset_first(spark, sf):
    return R.drop_duplicates(
        _orders_twice(spark, sf), "subset_keep", ["o_custkey", "o_orderstatus"], "first", ["o_orderkey", "copy"]
    )


@query(_NUMBERED.format(order="o_orderkey DESC, copy DESC"))
def q_dedup_subset_last(spark, sf):
    return R.drop_duplicates(
        _orders_twice(spark, sf), "subset_keep", ["o_custkey", "o_orderstatus"], "last", ["o_orderkey", "copy"]
    )


@query(
    _TWICE
    + "SELECT * FROM twice WHERE (o_custkey, o_orderstatus) IN "
    "(SELECT (o_custkey, o_orderstatus) FROM twice GROUP BY o_custkey, o_orderstatus HAVING count(*) = 1)"
)
def q_dedup_drop_all(spark, sf):
    return R.drop_duplicates(_orders_twice(spark, sf), "drop_all", ["o_custkey", "o_orderstatus"])


# --- nulls -----------------------------------------------------------------------------


@query(
    f"WITH {EVENTS} SELECT * FROM ev WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL"
)
def q_drop_nulls_any(spark, sf):
    return N.drop_nulls(events_with_nulls(spark, sf))


@query(f"WITH {EVENTS} SELECT * FROM ev WHERE user_id IS NOT NULL OR value IS NOT NULL")
def q_drop_nulls_all(spark, sf):
    return N.drop_nulls(events_with_nulls(spark, sf), "all", ["user_id", "value"])


@query(f"WITH {EVENTS} SELECT * FROM ev WHERE event_type IS NOT NULL")
def q_drop_nulls_subset(spark, sf):
    return N.drop_nulls(events_with_nulls(spark, sf), "any", ["event_type"])


@query(f"WITH {EVENTS} SELECT event_id, user_id, event_type FROM ev")
def q_drop_null_columns(spark, sf):
    return N.drop_null_columns(events_with_nulls(spark, sf), 10)


@query(
    f"WITH {EVENTS} SELECT event_id, user_id, coalesce(event_type, 'unknown') AS event_type, value FROM ev"
)
def q_fill_constant(spark, sf):
    return N.fill_nulls(events_with_nulls(spark, sf), "constant", "event_type", "unknown").df


@query(
    f"""WITH {EVENTS}, s AS (SELECT CAST(round_even(avg(user_id), 0) AS BIGINT) AS u, avg(value) AS v FROM ev)
SELECT event_id, coalesce(user_id, u) AS user_id, event_type, round(coalesce(value, v), 4) AS value
FROM ev, s"""
)
def q_fill_mean(spark, sf):
    return rounded(N.fill_nulls(events_with_nulls(spark, sf), "mean", ["user_id", "value"]).df)


@query(
    f"""WITH {EVENTS}, s AS (
  SELECT CAST(round_even(quantile_cont(user_id, 0.5), 0) AS BIGINT) AS u, quantile_cont(value, 0.5) AS v FROM ev)
SELECT event_id, coalesce(user_id, u) AS user_id, event_type, round(coalesce(value, v), 4) AS value
FROM ev, s"""
)
def q_fill_median(spark, sf):
    return rounded(N.fill_nulls(events_with_nulls(spark, sf), "median", ["user_id", "value"]).df)


def _mode(column):
    return (
        f"(SELECT {column} FROM ev WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


@query(
    f"""WITH {EVENTS}
SELECT event_id, user_id, coalesce(event_type, {_mode('event_type')}) AS event_type,
       coalesce(value, {_mode('value')}) AS value
FROM ev"""
)
def q_fill_mode(spark, sf):
    return N.fill_nulls(events_with_nulls(spark, sf), "mode", ["event_type", "value"]).df


def _along(direction):
    return f"""WITH {EVENTS}
SELECT event_id, user_id,
       last_value(event_type IGNORE NULLS) OVER w AS event_type, last_value(value IGNORE NULLS) OVER w AS value
FROM ev WINDOW w AS (ORDER BY event_id {direction} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query(_along("ASC"))
def q_fill_ffill(spark, sf):
    return N.fill_nulls(events_with_nulls(spark, sf), "ffill", ["event_type", "value"], order_by="event_id").df


@query(_along("DESC"))
def q_fill_bfill(spark, sf):
    return N.fill_nulls(events_with_nulls(spark, sf), "bfill", ["event_type", "value"], order_by="event_id").df


# --- casts -----------------------------------------------------------------------------

_DIRTY_SELECT = """event_id,
  CASE WHEN event_id % 5 = 0 THEN 'ten' WHEN event_id % 11 = 0 THEN '5d' WHEN event_id % 17 = 0 THEN '1_000'
       WHEN event_id % 19 = 0 THEN ' 7.5 ' WHEN event_id % 23 = 0 THEN '1e3'
       ELSE CAST(user_id AS {text}) END AS amount,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 8 = 0 THEN '' WHEN event_id % 9 = 0 THEN NULL ELSE 'False' END AS flag,
  event_id * 2.0 AS twice"""
_DIRTY = f"dirty AS (SELECT {_DIRTY_SELECT.format(text='VARCHAR')} FROM events)"


def _dirty(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("gristmill_events")
    return spark.sql(f"SELECT {_DIRTY_SELECT.format(text='STRING')} FROM gristmill_events").withColumn(
        "twice", F.col("twice").cast("double")
    )


_NUM = (
    r"CASE WHEN regexp_full_match(amount, '\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*') "
    "THEN CAST(trim(amount) AS DOUBLE) END"
)


@query(f"WITH {_DIRTY} SELECT event_id, {_NUM} AS amount FROM dirty")
def q_cast_numeric(spark, sf):
    return C.cast(_dirty(spark, sf), {"amount": "numeric"}).select("event_id", "amount")


@query(
    f"WITH {_DIRTY} SELECT event_id, CAST(trunc({_NUM}) AS BIGINT) AS amount, CAST(twice AS BIGINT) AS twice FROM dirty"
)
def q_cast_integer(spark, sf):
    cast = C.cast(_dirty(spark, sf), {"amount": "integer", "twice": "integer"}, truncate=True)
    return cast.select("event_id", "amount", "twice")


@query(
    f"""WITH {_DIRTY}
SELECT event_id, coalesce(CAST(value AS VARCHAR), 'nan') AS value, CAST(CAST(twice AS DOUBLE) AS VARCHAR) AS twice,
       coalesce(flag, 'nan') AS flag
FROM dirty"""
)
def q_cast_string(spark, sf):
    cast = C.cast(_dirty(spark, sf), {"value": "string", "twice": "string", "flag": "string"})
    return cast.select("event_id", "value", "twice", "flag")


@query(
    f"""WITH {_DIRTY}
SELECT event_id, coalesce(value <> 0, TRUE) AS value, coalesce(length(flag) > 0, FALSE) AS flag FROM dirty"""
)
def q_cast_boolean(spark, sf):
    return C.cast(_dirty(spark, sf), {"value": "boolean", "flag": "boolean"}).select(
        "event_id", "value", "flag"
    )


def _dated(spark, sf):
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 9 == 4, F.date_format(day, "dd-MM-yyyy")).otherwise(
        F.date_format(day, "yyyy-MM-dd")
    )
    return table(spark, sf, "orders").select("o_orderkey", text.alias("day"))


_DATED = """dated AS (
  SELECT o_orderkey, o_orderdate,
         CASE WHEN o_orderkey % 9 = 4 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
  FROM orders)"""


@query(f"WITH {_DATED} SELECT o_orderkey, try_strptime(day, '%Y-%m-%d') AS day FROM dated")
def q_cast_datetime(spark, sf):
    cast = C.cast(_dated(spark, sf), {"day": "datetime"}, order_by="o_orderkey")
    return cast.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    f"WITH {_DIRTY} SELECT event_id, {_NUM} AS amount, value, flag, CAST(twice AS BIGINT) AS twice FROM dirty"
)
def q_stored_casts(spark, sf):
    casts = {"amount": "float", "twice": "integer", "value": "integer", "gone": "string"}
    return C.apply_stored_casts(_dirty(spark, sf), casts)


@query(
    f"""WITH {_DIRTY}, s AS (
  SELECT count(*) AS total,
         count(*) FILTER (amount IS NOT NULL AND ({_NUM}) IS NULL) AS lost,
         count(*) FILTER (value IS NOT NULL AND value <> trunc(value)) AS fractions,
         count(*) FILTER (flag IS NULL) AS nulls
  FROM dirty)
SELECT 'amount' AS "column", 'numeric' AS target, 'warning' AS status,
       lost || ' cells, ' || CAST(CAST(round(lost * 100.0 / total, 1) AS DOUBLE) AS VARCHAR)
       || ' percent of all rows, do not convert and turn null' AS message FROM s
UNION ALL
SELECT 'value', 'integer', CASE WHEN fractions > 0 THEN 'warning' ELSE 'safe' END,
       CASE WHEN fractions > 0 THEN 'fractions are cut off'
            ELSE 'every value converts' END FROM s
UNION ALL
SELECT 'flag', 'string', 'warning', nulls || ' nulls turn into the text ''nan''' FROM s
UNION ALL
SELECT 'twice', 'float', 'safe', 'every value converts' FROM s"""
)
def q_validate_cast(spark, sf):
    return C.validate_cast(
        _dirty(spark, sf), {"amount": "numeric", "value": "integer", "flag": "string", "twice": "float"}
    )


@query(
    f"""WITH {_DIRTY}
SELECT event_id, {_NUM} AS amount, value, coalesce(flag, 'nan') AS flag, CAST(twice AS BIGINT) AS twice FROM dirty"""
)
def q_cast_columns(spark, sf):
    targets = {"amount": "numeric", "value": "integer", "flag": "string", "twice": "integer"}
    return C.cast_columns(_dirty(spark, sf), targets, force=True)[0]


# --- column edits ----------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer")
def q_rename_column(spark, sf):
    return C.rename_column(table(spark, sf, "customer"), "c_acctbal", "balance")[0]


@query("SELECT c_custkey, c_acctbal FROM customer")
def q_drop_columns(spark, sf):
    return C.drop_columns(table(spark, sf, "customer"), ["c_name", "c_nationkey", "c_mktsegment"])[0]


@query("SELECT c_custkey AS customer_key, c_name AS full_name, c_acctbal AS acct_bal FROM customer")
def q_normalize_names(spark, sf):
    named = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" Customer Key "),
        F.col("c_name").alias("FULL--Name!"),
        F.col("c_acctbal").alias("acct bal"),
    )
    return C.normalize_column_names(named)[0]


for _formula, _sql in (
    ("divide", "l_extendedprice / nullif(l_discount, 0)"),
    ("multiply", "l_extendedprice * l_discount"),
    ("add", "l_extendedprice + l_discount"),
    ("subtract", "l_extendedprice - l_discount"),
):
    register(
        f"q_add_column_{_formula}",
        lambda s, d, f=_formula: rounded(
            C.add_column(
                table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount"),
                "result",
                f,
                "l_extendedprice",
                "l_discount",
            )
        ),
        f"""SELECT l_orderkey, l_partkey, l_extendedprice, l_discount, round({_sql}, 4) AS result FROM lineitem""",
    )


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey = 42 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders"
)
def q_update_cell(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.update_cell(orders, {"o_orderkey": 42}, "o_totalprice", "1.5")


@query(
    """SELECT o_orderkey,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders"""
)
def q_replace_values(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return C.replace_values(orders, {"1-URGENT": "now", "5-LOW": None}, ["o_orderpriority"]).df


# --- formulas --------------------------------------------------------------------------

for _formula, _target, _a, _b, _sql in (
    ("divide", "quot", "l_extendedprice", "l_discount", "l_extendedprice / nullif(l_discount, 0)"),
    ("multiply", "prod", "l_quantity", "l_extendedprice", "l_quantity * l_extendedprice"),
    ("add", "total", "l_quantity", "l_extendedprice", "l_quantity + l_extendedprice"),
    ("subtract", "gap", "l_quantity", "l_extendedprice", "l_quantity - l_extendedprice"),
):
    register(
        f"q_fill_derived_{_formula}",
        lambda s, d, f=_formula, t=_target, a=_a, b=_b: rounded(
            X.fill_derived(bad_lines(s, d), t, f, a, b).df.select("l_orderkey", "l_partkey", t)
        ),
        f"WITH {BAD_LINES} SELECT l_orderkey, l_partkey, round(coalesce({_target}, {_sql}), 4) AS {_target} FROM li",
    )

_OFF = "abs(l_quantity * l_extendedprice - prod)"


@query(
    f"""WITH {BAD_LINES}, s AS (
  SELECT count(*) AS total_rows, count({_OFF}) AS checked_rows, count(*) FILTER ({_OFF} > 0.01) AS error_count FROM li)
SELECT *, round(error_count * 100.0 / checked_rows, 1) AS error_pct FROM s"""
)
def q_validate_formula(spark, sf):
    return X.validate_formula(bad_lines(spark, sf), "prod", "multiply", "l_quantity", "l_extendedprice")


@query(
    f"""WITH {BAD_LINES}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, round(prod, 4) AS prod,
       round(l_quantity * l_extendedprice, 4) AS calculated, round({_OFF}, 4) AS difference
FROM li WHERE {_OFF} > 0.01 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5"""
)
def q_formula_error_sample(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rounded(
        X.formula_error_sample(bad_lines(spark, sf), "prod", "multiply", "l_quantity", "l_extendedprice", keys)
    )


@query(
    f"""WITH {BAD_LINES}
SELECT l_orderkey, l_partkey,
       round(CASE WHEN {_OFF} > 0.01 THEN l_quantity * l_extendedprice ELSE prod END, 4) AS prod
FROM li"""
)
def q_fix_formula(spark, sf):
    fixed = X.fix_formula(bad_lines(spark, sf), "prod", "multiply", "l_quantity", "l_extendedprice")
    return rounded(fixed.df.select("l_orderkey", "l_partkey", "prod"))


# --- reports of the mutations ----------------------------------------------------------


@query(
    f"""WITH {EVENTS}
SELECT 'event_type' AS "column", count(*) - count(event_type) AS nulls, FALSE AS skipped,
       count(*) - count(event_type) AS cells_filled FROM ev
UNION ALL
SELECT 'value', count(*) - count(value), FALSE, count(*) - count(value) FROM ev"""
)
def q_fill_mode_metrics(spark, sf):
    return N.fill_nulls(events_with_nulls(spark, sf), "mode", ["event_type", "value"]).metrics


@query(f"WITH {BAD_LINES} SELECT count(*) AS cells_fixed FROM li WHERE {_OFF} > 0.01")
def q_fix_formula_metrics(spark, sf):
    fixed = X.fix_formula(bad_lines(spark, sf), "prod", "multiply", "l_quantity", "l_extendedprice")
    return fixed.metrics


@query(
    """SELECT 'o_orderpriority' AS "column", count(*) AS cells_replaced FROM orders
WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"""
)
def q_replace_values_metrics(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return C.replace_values(orders, {"1-URGENT": "now", "5-LOW": None}, ["o_orderpriority"]).metrics


# --- cases that used to go wrong -------------------------------------------------------


def _keyless(spark, sf):
    """Events whose only values of a quarter stand in rows without a key."""
    return table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_id = 7 THEN NULL ELSE event_id END AS place",
        "CASE WHEN event_id = 7 OR event_id % 50 = 3 THEN value END AS value",
    )


_KEYLESS = """k AS (SELECT event_id, CASE WHEN event_id = 7 THEN NULL ELSE event_id END AS place,
  CASE WHEN event_id = 7 OR event_id % 50 = 3 THEN value END AS value FROM events)"""


@query(
    f"""WITH {_KEYLESS} SELECT event_id, place, last_value(value IGNORE NULLS) OVER w AS value FROM k
WINDOW w AS (ORDER BY place NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def q_fill_ffill_null_key(spark, sf):
    return N.fill_nulls(_keyless(spark, sf), "ffill", ["value"], order_by=["place", "event_id"]).df


@query(
    f"""WITH {_KEYLESS} SELECT event_id, place, last_value(value IGNORE NULLS) OVER w AS value FROM k
WINDOW w AS (ORDER BY place DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def q_fill_bfill_null_key(spark, sf):
    return N.fill_nulls(_keyless(spark, sf), "bfill", ["value"], order_by="place").df


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_orderkey * 2.0
  ELSE o_totalprice END AS o_totalprice FROM orders"""
)
def q_update_cells(spark, sf):
    """Patches for two thirds of the keys, every patch given twice; unknown keys change nothing."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    patches = orders.selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey * 2.0D END AS o_totalprice"
    ).where("o_orderkey % 3 < 2")
    unknown = patches.selectExpr("-o_orderkey - 1 AS o_orderkey", "o_totalprice")
    return C.update_cells(orders, patches.union(patches).union(unknown), "o_orderkey", "o_totalprice")


@query(f"WITH {EVENTS} SELECT event_id, 'ne' AS kept FROM ev UNION ALL SELECT event_id, 'ne' FROM ev UNION ALL SELECT event_id, 'ne' FROM ev")
def q_filter_eq_mismatch(spark, sf):
    """A value of another kind equals no row and differs from every row, a number written as text too."""
    events = events_with_nulls(spark, sf)
    parts = [R.filter_rows(events, c, op, v).selectExpr("event_id", f"'{op}' AS kept")
             for c, v in (("value", "abc"), ("event_type", 5), ("user_id", "1")) for op in ("eq", "ne")]
    return reduce(DataFrame.union, parts)


@query(f"WITH {EVENTS} SELECT event_id, coalesce(user_id, 3) AS user_id FROM ev")
def q_fill_constant_integer(spark, sf):
    """A whole number given as a double fits an integer column."""
    return N.fill_nulls(events_with_nulls(spark, sf).select("event_id", "user_id"), "constant", ["user_id"], value=3.0).df


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey * 1000000000000000 AS a, 10000 AS b,
  CASE WHEN l_partkey * 1000000000000000::HUGEINT * 10000 <= 9223372036854775807 THEN (l_partkey * 1000000000000000::HUGEINT * 10000)::BIGINT END AS p
FROM lineitem"""
)
def q_add_column_overflow(spark, sf):
    """A product that does not fit a bigint is null, an operand too."""
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "try_multiply(l_partkey, 1000000000000000L) AS a", "10000L AS b"
    )
    return C.add_column(lines, "p", "multiply", "a", "b")


@query("SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey, true AS marked FROM customer")
def q_cast_category(spark, sf):
    """Values stay as text, nulls stay null, and the column carries its logical type."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    made = C.cast(rows, {"c_mktsegment": "category", "c_nationkey": "category"})
    marked = all(made.schema[c].metadata == {C.LOGICAL_TYPE: "category"} for c in ("c_mktsegment", "c_nationkey"))
    return made.withColumn("marked", F.lit(marked))


@query("SELECT c_custkey AS customer_key, c_name AS full_name FROM customer")
def q_normalize_columns(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias(" Customer  Key "), F.col("c_name").alias("FULL name"))
    return C.normalize_columns(rows)


# --- statistics of one table applied to another ---------------------------------------


@query("""
WITH f AS (SELECT quantile_cont(l_extendedprice, 0.05) AS low, quantile_cont(l_extendedprice, 0.95) AS high,
                  avg(l_quantity) AS base, stddev_samp(l_quantity) AS width
           FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01')
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - base) / width, 4) AS l_quantity,
       round(least(greatest(l_extendedprice, low), high), 4) AS l_extendedprice
FROM lineitem, f""")
def q_fitted_on_earlier_rows(spark, sf):
    """Caps and scales that earlier shipments give, applied to all shipments."""
    lines = table(spark, sf, "lineitem")
    earlier = lines.where("l_shipdate < TIMESTAMP '1995-06-01'")
    steps = [FT.fit_cap(earlier, ["l_extendedprice"]), FT.fit_scale(earlier, ["l_quantity"], "zscore")]
    kept = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return rounded(FT.apply_all(lines.select(*kept), steps))


@query("""
WITH m AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events WHERE user_id < 50 AND event_type IS NOT NULL GROUP BY event_type)
SELECT event_id, coalesce(code, -1)::BIGINT AS event_type FROM events LEFT JOIN m USING (event_type)""")
def q_fitted_label_codes(spark, sf):
    """Label codes of some users' events, applied to everyone's."""
    events = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    codes = FT.LabelCodes.fit(events.where("user_id < 50"), ["event_type"], ["event_id"])
    return codes.apply(events.select("event_id", "event_type"))
