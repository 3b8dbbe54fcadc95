"""Outliers, transforms, scaling, text cleaning, date parts, encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import outliers as O, transforms as T
from gristmill.queries.registry import EVENTS, events_with_nulls, query, register, rounded, table

# --- outlier bounds in SQL --------------------------------------------------------------


def _iqr(rel: str, column: str, t: float = 1.5) -> str:
    return (
        f"SELECT quantile_cont({column}, 0.25) - {t} * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) AS lo, "
        f"quantile_cont({column}, 0.75) + {t} * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) AS hi, "
        f"count(*) AS total, avg({column}) AS mean, stddev_samp({column}) AS std, min({column}) AS mn, "
        f"max({column}) AS mx, quantile_cont({column}, 0.5) AS med FROM {rel}"
    )


def _zscore(rel: str, column: str, t: float) -> str:
    return (
        f"SELECT avg({column}) - {t} * stddev_samp({column}) AS lo, avg({column}) + {t} * stddev_samp({column}) AS hi, "
        f"count(*) AS total, avg({column}) AS mean, stddev_samp({column}) AS std, min({column}) AS mn, "
        f"max({column}) AS mx, quantile_cont({column}, 0.5) AS med FROM {rel}"
    )


@query(
    f"""WITH a AS ({_iqr('orders', 'o_totalprice')}), b AS ({_iqr('orders', 'o_custkey')})
SELECT 'o_totalprice' AS "column", round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound FROM a
UNION ALL SELECT 'o_custkey', round(lo, 4), round(hi, 4) FROM b"""
)
def q_outlier_bounds_iqr(spark, sf):
    return rounded(O.outlier_bounds(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"]))


@query(
    f"""WITH {EVENTS}, a AS ({_zscore('ev', 'value', 2.0)})
SELECT 'value' AS "column", round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound FROM a"""
)
def q_outlier_bounds_zscore(spark, sf):
    return rounded(O.outlier_bounds(events_with_nulls(spark, sf), ["value"], "zscore", 2.0))


def _detected(rel: str, column: str, bounds: str, name: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) FILTER ({column} < lo OR {column} > hi) AS outlier_count,
  round(count(*) FILTER ({column} < lo OR {column} > hi) * 100.0 / count(*), 1) AS outlier_pct,
  round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound, round(any_value(mn), 4) AS "min",
  round(any_value(mx), 4) AS "max", round(any_value(mean), 4) AS mean, round(any_value(med), 4) AS median
FROM {rel}, {name}"""


@query(
    f"""WITH {EVENTS}, a AS ({_iqr('ev', 'value')}), b AS ({_iqr('ev', 'user_id')})
{_detected('ev', 'value', '', 'a')} UNION ALL {_detected('ev', 'user_id', '', 'b')}"""
)
def q_detect_outliers(spark, sf):
    return O.detect_outliers(events_with_nulls(spark, sf), ["value", "user_id"])


@query(
    f"""WITH {EVENTS}, a AS ({_zscore('ev', 'value', 3.0)}) {_detected('ev', 'value', '', 'a')}"""
)
def q_detect_outliers_zscore(spark, sf):
    return O.detect_outliers(events_with_nulls(spark, sf), ["value"], "zscore")


@query(
    f"""WITH {EVENTS}, a AS ({_iqr('ev', 'value')})
SELECT 'value' AS "column", event_id, value, row_number() OVER (ORDER BY event_id) AS rank
FROM ev, a WHERE value < lo OR value > hi ORDER BY event_id LIMIT 5"""
)
def q_outlier_sample(spark, sf):
    return O.outlier_sample(events_with_nulls(spark, sf), ["value"], "event_id")


@query(
    f"""WITH {EVENTS}, a AS ({_iqr('ev', 'value')}), b AS ({_iqr('ev', 'user_id')})
SELECT ev.* FROM ev, a, b
WHERE NOT coalesce(value < a.lo OR value > a.hi, FALSE) AND NOT coalesce(user_id < b.lo OR user_id > b.hi, FALSE)"""
)
def q_trim_outliers_iqr(spark, sf):
    return O.trim_outliers(events_with_nulls(spark, sf), ["value", "user_id"])


@query(
    f"""WITH {EVENTS}, a AS ({_zscore('ev', 'value', 2.0)})
SELECT ev.* FROM ev, a WHERE NOT coalesce(value < a.lo OR value > a.hi, FALSE)"""
)
def q_trim_outliers_zscore(spark, sf):
    return O.trim_outliers(events_with_nulls(spark, sf), ["value"], "zscore", 2.0)


for _strategy, _new in (
    ("mean", "mean"),
    ("median", "med"),
    (
        "mode",
        "(SELECT value FROM ev WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)",
    ),
):
    register(
        f"q_impute_outliers_{_strategy}",
        lambda s, d, k=_strategy: rounded(
            O.impute_outliers(events_with_nulls(s, d), ["value"], k).df
        ),
        f"""WITH {EVENTS}, a AS ({_iqr('ev', 'value')})
SELECT event_id, user_id, event_type,
       round(CASE WHEN value < lo OR value > hi THEN {_new} ELSE value END, 4) AS value
FROM ev, a""",
    )


@query(
    f"""WITH {EVENTS}, a AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM ev)
SELECT event_id, user_id, event_type, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 4) AS value
FROM ev, a"""
)
def q_cap_outliers(spark, sf):
    return rounded(O.cap_outliers(events_with_nulls(spark, sf), ["value"]).df)


_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_LINE_BOUNDS = ", ".join(f"b{i} AS ({_iqr('lineitem', c)})" for i, c in enumerate(_LINE_NUMBERS))
_LINE_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < lo OR {c} > hi) AS outlier_count,
  round(count(*) FILTER ({c} < lo OR {c} > hi) * 100.0 / count(*), 2) AS outlier_pct,
  round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound, round(any_value(mean), 4) AS mean,
  round(any_value(std), 4) AS std FROM lineitem, b{i}"""
    for i, c in enumerate(_LINE_NUMBERS)
)


def _line_numbers(spark, sf):
    return table(spark, sf, "lineitem").select(*_LINE_NUMBERS, "l_returnflag")


@query(f"WITH {_LINE_BOUNDS} {_LINE_SUMMARY}")
def q_outlier_summary(spark, sf):
    return O.outlier_summary(_line_numbers(spark, sf))


@query(
    f"""WITH {_LINE_BOUNDS}, s AS ({_LINE_SUMMARY})
SELECT (SELECT count(*) FROM lineitem) AS total_rows, count(*) AS numeric_columns_checked,
       count(*) FILTER (outlier_count > 0) AS columns_with_outliers,
       CAST(sum(outlier_count) AS BIGINT) AS total_outlier_cells FROM s"""
)
def q_outlier_summary_totals(spark, sf):
    return O.outlier_summary_totals(_line_numbers(spark, sf))


# --- transforms ------------------------------------------------------------------------


def _balances(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_acctbal", "c_acctbal + 2000 AS shifted", "1.0D + 0 * c_acctbal AS fixed"
    )


_BALANCES = "cu AS (SELECT c_custkey, c_acctbal, c_acctbal + 2000 AS shifted, CAST(1.0 AS DOUBLE) AS fixed FROM customer)"


@query(
    f"""WITH {_BALANCES}
SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal, round(ln(shifted), 4) AS shifted, fixed FROM cu"""
)
def q_transform_log(spark, sf):
    return rounded(
        T.transform_columns(_balances(spark, sf), ["c_acctbal", "shifted"], "log").df
    )


@query(
    f"""WITH {_BALANCES}
SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal, round(sqrt(shifted), 4) AS shifted, fixed FROM cu"""
)
def q_transform_sqrt(spark, sf):
    return rounded(
        T.transform_columns(_balances(spark, sf), ["c_acctbal", "shifted"], "sqrt").df
    )


@query(
    f"""WITH {_BALANCES}
SELECT c_custkey, round(cbrt(c_acctbal), 4) AS c_acctbal, round(cbrt(shifted), 4) AS shifted, fixed FROM cu"""
)
def q_transform_cbrt(spark, sf):
    return rounded(
        T.transform_columns(_balances(spark, sf), ["c_acctbal", "shifted"], "cbrt").df
    )


@query(
    """SELECT 'c_acctbal' AS "column", min(c_acctbal) <= 0 AS skipped,
  CASE WHEN min(c_acctbal) <= 0 THEN 'contains zero or negative values' END AS reason FROM customer
UNION ALL SELECT 'shifted', min(c_acctbal + 2000) <= 0, NULL FROM customer"""
)
def q_transform_skipped(spark, sf):
    return T.transform_columns(_balances(spark, sf), ["c_acctbal", "shifted"], "log").metrics


@query(
    f"""WITH {_BALANCES}, s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(shifted) AS slo, max(shifted) AS shi FROM cu)
SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS c_acctbal, round((shifted - slo) / (shi - slo), 6) AS shifted, fixed
FROM cu, s"""
)
def q_scale_minmax(spark, sf):
    return rounded(
        T.scale_columns(_balances(spark, sf), ["c_acctbal", "shifted", "fixed"], "minmax").df, 6
    )


@query(
    f"""WITH {_BALANCES}, s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM cu)
SELECT c_custkey, round((c_acctbal - m) / sd, 6) AS c_acctbal, round(shifted, 6) AS shifted, fixed FROM cu, s"""
)
def q_scale_zscore(spark, sf):
    return rounded(T.scale_columns(_balances(spark, sf), ["c_acctbal", "fixed"], "zscore").df, 6)


# --- text ------------------------------------------------------------------------------


def _padded(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey % 3 = 0 THEN concat('  \\t', c_mktsegment, ' \\n') "
        "WHEN c_custkey % 7 = 0 THEN NULL ELSE lower(c_mktsegment) END AS segment",
    )


_PADDED = r"""cu AS (
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '  ' || chr(9) || c_mktsegment || ' ' || chr(10)
    WHEN c_custkey % 7 = 0 THEN NULL ELSE lower(c_mktsegment) END AS segment FROM customer)"""

for _name, _sql in (
    ("strip", r"regexp_replace(segment, '^\s+|\s+$', '', 'g')"),
    ("lower", "lower(segment)"),
    ("upper", "upper(segment)"),
):
    register(
        f"q_clean_{_name}",
        lambda s, d, k=_name: T.clean_strings(_padded(s, d), "segment", k).df,
        f"WITH {_PADDED} SELECT c_custkey, {_sql} AS segment FROM cu",
    )


def _odd_names(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey",
        "CASE WHEN p_partkey % 4 = 0 THEN concat('o''', p_name) WHEN p_partkey % 4 = 1 THEN concat(p_name, '-3rd part') "
        "ELSE upper(p_name) END AS p_name",
    )


@query(
    r"""WITH p AS (
  SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'o''' || p_name WHEN p_partkey % 4 = 1 THEN p_name || '-3rd part'
    ELSE upper(p_name) END AS p_name FROM part)
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '[\p{L}]+|[^\p{L}]+'),
  lambda x: upper(x[1]) || lower(x[2:])), '') AS p_name FROM p"""
)
def q_clean_title(spark, sf):
    return T.clean_strings(_odd_names(spark, sf), "p_name", "title").df


@query(
    rf"""WITH {_PADDED}
SELECT 'segment' AS "column",
  count(*) FILTER (regexp_replace(segment, '^\s+|\s+$', '', 'g') <> segment) AS cells_changed FROM cu"""
)
def q_clean_strip_metrics(spark, sf):
    return T.clean_strings(_padded(spark, sf), "segment", "strip").metrics


# --- dates and encodings ---------------------------------------------------------------


@query(
    """SELECT event_id, year(ts) AS ts_year, month(ts) AS ts_month, day(ts) AS ts_day, isodow(ts) - 1 AS ts_weekday,
  hour(ts) AS ts_hour, minute(ts) AS ts_minute FROM events"""
)
def q_extract_datetime(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    return T.extract_datetime(
        events, "ts", ["year", "month", "day", "weekday", "hour", "minute"]
    ).drop("ts")


@query(
    f"""WITH {EVENTS}, f AS (
  SELECT event_type, min(event_id) AS first FROM ev WHERE event_type IS NOT NULL GROUP BY event_type),
c AS (SELECT event_type, row_number() OVER (ORDER BY first) - 1 AS code FROM f)
SELECT event_id, user_id, coalesce(code, -1) AS event_type, value FROM ev LEFT JOIN c USING (event_type)"""
)
def q_encode_label(spark, sf):
    return T.encode_label(events_with_nulls(spark, sf), "event_type", "event_id")[0]


@query(
    f"""WITH {EVENTS}, f AS (
  SELECT event_type, min(event_id) AS first FROM ev WHERE event_type IS NOT NULL GROUP BY event_type)
SELECT 'event_type' AS "column", event_type AS value, row_number() OVER (ORDER BY first) - 1 AS code FROM f"""
)
def q_encode_label_mapping(spark, sf):
    return T.encode_label(events_with_nulls(spark, sf), "event_type", "event_id")[1]


@query(
    "SELECT c_custkey, "
    + ", ".join(
        f"CASE WHEN c_custkey % 6 <> 0 AND c_mktsegment = '{v}' THEN 1 ELSE 0 END AS \"segment_{v}\""
        for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM customer"
)
def q_encode_onehot(spark, sf):
    customers = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS segment"
    )
    return T.encode_onehot(customers, "segment")
