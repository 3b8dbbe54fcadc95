"""Profiles, distributions, frequencies, correlation, missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import association as A, eda as E, profile as P, rank_correlation as K
from gristmill.queries.registry import EVENTS, events_with_nulls, query, rounded, table

_EV_TYPES = (("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"))

# --- profiles --------------------------------------------------------------------------

_INSPECT = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls,
  round((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct, count(DISTINCT {c}) AS unique_count,
  count(DISTINCT {c}) = count({c}) AS is_unique FROM ev"""
    for c, t in _EV_TYPES
)


@query(f"WITH {EVENTS} {_INSPECT}")
def q_inspect(spark, sf):
    return P.inspect(events_with_nulls(spark, sf))


@query(f'WITH {EVENTS}, i AS ({_INSPECT}) SELECT "column", dtype, null_pct, unique_count FROM i')
def q_cleaning_stats(spark, sf):
    return P.cleaning_stats(events_with_nulls(spark, sf))


def _described(rel: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(CAST(min({c}) AS DOUBLE), 4) AS "min", round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
  round(quantile_cont({c}, 0.75), 4) AS p75, round(CAST(max({c}) AS DOUBLE), 4) AS "max" FROM {rel}"""


@query(f"WITH {EVENTS} " + " UNION ALL ".join(_described("ev", c) for c in ("event_id", "user_id", "value")))
def q_describe_numeric(spark, sf):
    return rounded(P.describe_numeric(events_with_nulls(spark, sf)))


def _top(rel: str, c: str) -> str:
    return f"(SELECT {c} FROM {rel} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", count(DISTINCT {c}) AS "unique", {_top('orders', c)} AS top,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY {c})) AS freq FROM orders"""
        for c in ("o_orderstatus", "o_orderpriority")
    )
)
def q_describe_text(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    return P.describe_text(orders)


@query(
    """WITH m AS (SELECT epoch_us(ts) AS u FROM events)
SELECT 'ts' AS "column", count(u) AS "count", make_timestamp(CAST(floor(CAST(sum(u) AS HUGEINT) // count(u)) AS BIGINT)) AS mean,
  make_timestamp(min(u)) AS "min", make_timestamp(CAST(floor(quantile_cont(u, 0.25)) AS BIGINT)) AS p25,
  make_timestamp(CAST(floor(quantile_cont(u, 0.5)) AS BIGINT)) AS p50,
  make_timestamp(CAST(floor(quantile_cont(u, 0.75)) AS BIGINT)) AS p75, make_timestamp(max(u)) AS "max" FROM m"""
)
def q_describe_datetime(spark, sf):
    out = P.describe_datetime(table(spark, sf, "events").select("ts"))
    return out.select(
        *[F.col(f.name).cast("timestamp_ntz").alias(f.name) if "timestamp" in f.dataType.simpleString() else F.col(f.name) for f in out.schema]
    )


def _summary_number(c: str) -> str:
    values = (
        ("min", f"CAST(min({c}) AS DOUBLE)"), ("max", f"CAST(max({c}) AS DOUBLE)"), ("mean", f"avg({c})"),
        ("median", f"quantile_cont({c}, 0.5)"), ("std", f"stddev_samp({c})"),
    )
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS total_rows, count(*) - count({c}) AS missing, '{n}' AS statistic,
  round({v}, 4) AS number, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS "count" FROM ev"""
        for n, v in values
    )


@query(
    f"""WITH {EVENTS}, g AS (SELECT event_type, count(*) AS n FROM ev WHERE event_type IS NOT NULL GROUP BY event_type),
r AS (SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS k FROM g)
{' UNION ALL '.join(_summary_number(c) for c in ('event_id', 'user_id', 'value'))}
UNION ALL SELECT 'event_type', (SELECT count(*) FROM ev), (SELECT count(*) - count(event_type) FROM ev),
  'top' || k, NULL, event_type, n FROM r WHERE k <= 5"""
)
def q_summary_stats(spark, sf):
    return rounded(P.summary_stats(events_with_nulls(spark, sf)))


def _context(c: str, t: str) -> str:
    numeric = t != "string"
    stats = (
        (f"avg({c})", f"stddev_samp({c})", f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)")
        if numeric
        else ("CAST(NULL AS DOUBLE)",) * 4
    )
    cells = ", ".join(f'round({s}, 4) AS "{n}"' for s, n in zip(stats, ("mean", "std", "min", "max")))
    return f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS total_rows, CAST(4 AS BIGINT) AS total_columns,
  round((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct, {cells} FROM ev"""


@query(f"WITH {EVENTS} " + " UNION ALL ".join(_context(c, t) for c, t in _EV_TYPES))
def q_profile_context(spark, sf):
    return rounded(P.profile_context(events_with_nulls(spark, sf)))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def q_profile_first_rows(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return P.first_rows(customers.withColumn("down", -F.col("c_acctbal")), ["down", "c_custkey"]).drop("down")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std FROM lineitem"""
        for c in (
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        )
    )
)
def q_sample_stats(spark, sf):
    return P.sample_stats(table(spark, sf, "lineitem"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def q_preview(spark, sf):
    return P.preview(
        table(spark, sf, "orders"), "o_orderkey", columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    )


@query(
    "SELECT count(*) AS total_rows, least(count(*), 100) AS returned_rows, count(*) > 100 AS truncated FROM orders"
)
def q_preview_info(spark, sf):
    return P.preview_info(table(spark, sf, "orders"))


# --- correlation -----------------------------------------------------------------------

_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "one")


def _lines(spark, sf):
    """Line items with nulls in two columns and a constant column."""
    return table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
        "l_extendedprice",
        "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount",
        "l_tax",
        "1.0D AS one",
    )


_LINES = """li AS (
  SELECT CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice,
         CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax, CAST(1.0 AS DOUBLE) AS one
  FROM lineitem)"""


def _r(a: str, b: str) -> str:
    if "one" in (a, b):
        return "CAST(NULL AS DOUBLE)"
    return f"(SELECT round(corr({a}, {b}), 4) FROM li)"


@query(
    f"WITH {_LINES} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {_r(a, b)} AS r"
        for a in _COLUMNS
        for b in _COLUMNS
    )
)
def q_corr_pearson(spark, sf):
    return E.correlation_pearson(_lines(spark, sf))


def _spearman(a: str, b: str) -> str:
    if "one" in (a, b):
        return "CAST(NULL AS DOUBLE)"
    if a == b:
        return "CAST(1.0 AS DOUBLE)"
    return f"""(SELECT round(corr(ra, rb), 4) FROM (
  SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rb
  FROM (SELECT {a} AS x, {b} AS y FROM li WHERE {a} IS NOT NULL AND {b} IS NOT NULL)))"""


@query(
    f"WITH {_LINES} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {_spearman(a, b)} AS r" for a in _COLUMNS for b in _COLUMNS
    )
)
def q_corr_spearman(spark, sf):
    return K.correlation_spearman(_lines(spark, sf))


_TAU = """WITH p AS (SELECT p_size AS x, p_retailprice AS y, count(*) AS w FROM part GROUP BY 1, 2),
pairs AS (
  SELECT sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN a.w * b.w ELSE 0 END) AS c,
         sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN a.w * b.w ELSE 0 END) AS d
  FROM p a JOIN p b ON a.x < b.x),
n AS (SELECT count(*) * (count(*) - 1) / 2.0 AS n0 FROM part),
tx AS (SELECT sum(t * (t - 1) / 2.0) AS n1 FROM (SELECT count(*) AS t FROM part GROUP BY p_size)),
ty AS (SELECT sum(t * (t - 1) / 2.0) AS n2 FROM (SELECT count(*) AS t FROM part GROUP BY p_retailprice)),
tau AS (SELECT round((c - d) / (sqrt(n0 - n1) * sqrt(n0 - n2)), 4) AS r FROM pairs, n, tx, ty)
SELECT 'p_size' AS column_a, 'p_retailprice' AS column_b, r FROM tau
UNION ALL SELECT 'p_retailprice', 'p_size', r FROM tau
UNION ALL SELECT 'p_size', 'p_size', 1.0 UNION ALL SELECT 'p_retailprice', 'p_retailprice', 1.0"""


@query(_TAU)
def q_corr_kendall(spark, sf):
    return K.correlation_kendall(table(spark, sf, "part"), ["p_size", "p_retailprice"])


# --- association -----------------------------------------------------------------------


def _cramer(rel: str, a: str, b: str) -> str:
    return f"""(SELECT CASE WHEN least(kt - 1, rt - 1) = 0 THEN 0.0 ELSE round(sqrt(p / least(kt - 1, rt - 1)), 4) END FROM (
  SELECT greatest(0, chi / n - (k - 1) * (r - 1) / (n - 1)) AS p, r - (r - 1) * (r - 1) / (n - 1) AS rt,
         k - (k - 1) * (k - 1) / (n - 1) AS kt FROM (
    SELECT any_value(n) AS n, any_value(r) AS r, any_value(k) AS k,
      sum(CASE WHEN r = 2 AND k = 2 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE pow(o - e, 2) / e END) AS chi
    FROM (
      SELECT coalesce(c.o, 0) AS o, ra.t * cb.t / n.n AS e, n.n, n.r, n.k
      FROM (SELECT {a} AS a, CAST(count(*) AS DOUBLE) AS t FROM {rel} GROUP BY 1) ra
      CROSS JOIN (SELECT {b} AS b, CAST(count(*) AS DOUBLE) AS t FROM {rel} GROUP BY 1) cb
      LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {rel} GROUP BY 1, 2) c ON c.a = ra.a AND c.b = cb.b
      CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT {a}) AS DOUBLE) AS r,
                         CAST(count(DISTINCT {b}) AS DOUBLE) AS k FROM {rel}) n))))"""


_CATEGORIES = """li AS (
  SELECT l_returnflag, l_linestatus, coalesce(CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END, 'nan') AS line,
         CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS size,
         CASE WHEN l_quantity > 30 OR l_tax > 0.06 THEN 'x' ELSE 'y' END AS kind
  FROM lineitem)"""
_CATEGORY_NAMES = ("l_returnflag", "l_linestatus", "line", "size", "kind")


@query(
    f"WITH {_CATEGORIES} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
        + ("CAST(1.0 AS DOUBLE)" if a == b else _cramer("li", *sorted((a, b))))
        + " AS v"
        for a in _CATEGORY_NAMES
        for b in _CATEGORY_NAMES
    )
)
def q_cramers_v(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_returnflag",
        "l_linestatus",
        "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_linenumber AS STRING) END AS line",
        "CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS size",
        "CASE WHEN l_quantity > 30 OR l_tax > 0.06 THEN 'x' ELSE 'y' END AS kind",
    )
    return A.categorical_association(lines)


# --- distributions ---------------------------------------------------------------------

_PRICES = "o AS (SELECT CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, CAST(o_custkey AS DOUBLE) AS customer, CAST(7.0 AS DOUBLE) AS fixed FROM orders)"


def _prices(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
        "CAST(o_custkey AS DOUBLE) AS customer",
        "7.0D AS fixed",
    )


def _distribution(c: str) -> str:
    skew, kurt = f"round(skewness({c}), 4)", f"round(kurtosis({c}), 4)"
    if c == "fixed":
        skew = kurt = "0.0"
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(min({c}), 4) AS "min", round(max({c}), 4) AS "max", {skew} AS skewness, {kurt} AS kurtosis FROM o"""


@query(f"WITH {_PRICES} " + " UNION ALL ".join(_distribution(c) for c in ("o_totalprice", "customer", "fixed")))
def q_distribution_stats(spark, sf):
    return E.distribution_stats(_prices(spark, sf), ["o_totalprice", "customer", "fixed"])


def _bins(c: str) -> str:
    return f"""SELECT '{c}' AS "column", b.i AS bin, round(lo + b.i * (hi - lo) / 20, 4) AS range_start,
  round(CASE WHEN b.i = 19 THEN hi ELSE lo + (b.i + 1) * (hi - lo) / 20 END, 4) AS range_end,
  coalesce(n, 0) AS "count"
FROM (SELECT min({c}) - CASE WHEN min({c}) = max({c}) THEN 0.5 ELSE 0 END AS lo,
             max({c}) + CASE WHEN min({c}) = max({c}) THEN 0.5 ELSE 0 END AS hi FROM o) r
CROSS JOIN (SELECT unnest(range(20)) AS i) b
LEFT JOIN (
  SELECT least(CAST(floor(({c} - lo) / ((hi - lo) / 20)) AS BIGINT), 19) AS i, count(*) AS n FROM (SELECT * FROM o WHERE {c} IS NOT NULL),
    (SELECT min({c}) - CASE WHEN min({c}) = max({c}) THEN 0.5 ELSE 0 END AS lo,
            max({c}) + CASE WHEN min({c}) = max({c}) THEN 0.5 ELSE 0 END AS hi FROM o) GROUP BY 1) c ON c.i = b.i"""


_ALL_BINS = " UNION ALL ".join(_bins(c) for c in ("o_totalprice", "customer", "fixed"))


@query(f"WITH {_PRICES} {_ALL_BINS}")
def q_distribution_bins(spark, sf):
    return E.distribution_bins(_prices(spark, sf), ["o_totalprice", "customer", "fixed"])


# --- frequencies -----------------------------------------------------------------------


def _frequent(rel: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", v AS value, n AS "count", round(n * 100.0 / total, 2) AS pct, k AS rank FROM (
  SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n, sum(count(*)) OVER () AS total,
         row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR) NULLS FIRST) AS k
  FROM {rel} GROUP BY 1) WHERE k <= 20"""


@query(f"WITH {EVENTS} " + " UNION ALL ".join(_frequent("ev", c) for c in ("event_type", "user_id")))
def q_value_counts(spark, sf):
    return E.value_counts(events_with_nulls(spark, sf), ["event_type", "user_id"])


@query(
    f"WITH {EVENTS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS total_rows, count(*) - count({c}) AS null_count,
  count(DISTINCT {c}) AS unique_count FROM ev"""
        for c in ("event_type", "user_id", "value")
    )
)
def q_value_counts_meta(spark, sf):
    return E.value_counts_meta(events_with_nulls(spark, sf), ["event_type", "user_id", "value"])


_PRIORITY = "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN '1-URGENT' ELSE o_orderpriority END"
_GRID = f"""WITH o AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS a, {_PRIORITY} AS b FROM orders),
g AS (SELECT x.a, y.b, count(o.a) AS n FROM (SELECT DISTINCT a FROM o WHERE a IS NOT NULL) x
  CROSS JOIN (SELECT DISTINCT b FROM o WHERE a IS NOT NULL) y LEFT JOIN o ON o.a = x.a AND o.b = y.b GROUP BY x.a, y.b) """


def _crossed(spark, sf):
    """Every order; one cell of the cross table is emptied by relabelling."""
    return table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS status", f"{_PRIORITY} AS priority"
    )


@query(_GRID + "SELECT a, b, n FROM g")
def q_crosstab(spark, sf):
    return E.crosstab(_crossed(spark, sf), "status", "priority")


@query(_GRID + "SELECT a, b, round(n / sum(n) OVER (PARTITION BY a), 4) AS n FROM g")
def q_crosstab_normalized(spark, sf):
    return E.crosstab(_crossed(spark, sf), "status", "priority", normalize=True)


@query(
    _GRID
    + "SELECT a AS status, "
    + ", ".join(
        f"CAST(sum(n) FILTER (b = '{p}') AS BIGINT) AS \"{p}\""
        for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    )
    + " FROM g GROUP BY a"
)
def q_crosstab_wide(spark, sf):
    return E.crosstab_wide(_crossed(spark, sf), "status", "priority")


# --- missing values --------------------------------------------------------------------


@query(
    f"WITH {EVENTS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count,
  round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct FROM ev"""
        for c, _ in _EV_TYPES
    )
)
def q_missing_by_column(spark, sf):
    return E.missing_by_column(events_with_nulls(spark, sf))


@query(
    f"""WITH {EVENTS}, n AS (
  SELECT event_id, CAST((user_id IS NULL)::INT + (event_type IS NULL)::INT + (value IS NULL)::INT AS BIGINT) AS null_count FROM ev)
SELECT * FROM n WHERE null_count > 0 ORDER BY null_count DESC, event_id LIMIT 10"""
)
def q_missing_worst_rows(spark, sf):
    return E.missing_worst_rows(events_with_nulls(spark, sf), "event_id")


@query(
    f"""WITH {EVENTS}, r AS (
  SELECT 'user_id' AS column_a, 'value' AS column_b, round(corr((user_id IS NULL)::INT, (value IS NULL)::INT), 3) AS r FROM ev
  UNION ALL SELECT 'event_type', 'value', round(corr((event_type IS NULL)::INT, (value IS NULL)::INT), 3) FROM ev
  UNION ALL SELECT 'event_type', 'user_id', round(corr((event_type IS NULL)::INT, (user_id IS NULL)::INT), 3) FROM ev)
SELECT * FROM r WHERE abs(r) >= 0.5"""
)
def q_co_null_pairs(spark, sf):
    return E.co_null_pairs(events_with_nulls(spark, sf))


# --- pairs -----------------------------------------------------------------------------


@query(
    f"""WITH {EVENTS} SELECT count(*) FILTER (user_id IS NOT NULL AND value IS NOT NULL) AS n,
  round(corr(user_id, value), 4) AS r FROM ev"""
)
def q_pairwise_r(spark, sf):
    return E.pairwise_r(events_with_nulls(spark, sf), "user_id", "value")


@query(
    f"""WITH {EVENTS} SELECT event_id, user_id AS x, value AS y FROM ev
WHERE user_id IS NOT NULL AND value IS NOT NULL ORDER BY md5(event_id || ':42'), event_id LIMIT 500"""
)
def q_pairwise_points(spark, sf):
    return E.pairwise_points(events_with_nulls(spark, sf), "user_id", "value", "event_id")


# --- wide tables: no column is left out ------------------------------------------------

_WIDE = [f"CASE WHEN event_id % {k + 2} = 0 THEN 'a' WHEN user_id % {k + 3} = 0 THEN 'b' ELSE 'c' END AS k{k}" for k in range(60)]


def _wide(spark, sf):
    return table(spark, sf, "events").selectExpr(*_WIDE)


@query(
    f"WITH w AS (SELECT {', '.join(_WIDE)} FROM events) "
    + " UNION ALL ".join(_frequent("w", f"k{k}") for k in range(60))
)
def q_value_counts_wide(spark, sf):
    return E.value_counts(_wide(spark, sf))


@query(
    f"WITH w AS (SELECT {', '.join(_WIDE)} FROM events) "
    + " UNION ALL ".join(
        f"""SELECT 'k{k}' AS "column", count(*) AS total_rows, count(*) - count(k{k}) AS null_count, count(DISTINCT k{k}) AS unique_count FROM w"""
        for k in range(60)
    )
)
def q_value_counts_meta_wide(spark, sf):
    return E.value_counts_meta(_wide(spark, sf))


_NUMBERED_WIDE = f"""w AS (SELECT row_number() OVER () AS row, {', '.join(_WIDE)} FROM events),
u AS (UNPIVOT w ON COLUMNS(* EXCLUDE (row)) INTO NAME c VALUE v)"""


@query(
    f"""WITH {_NUMBERED_WIDE},
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM w),
m AS (SELECT c, v, CAST(count(*) AS DOUBLE) AS t FROM u GROUP BY c, v),
k AS (SELECT c, CAST(count(*) AS DOUBLE) AS k FROM m GROUP BY c),
cells AS (SELECT x.c AS a, y.c AS b, x.v AS va, y.v AS vb, count(*) AS o FROM u x JOIN u y ON x.row = y.row AND x.c < y.c GROUP BY ALL),
grid AS (
  SELECT ra.c AS a, cb.c AS b, coalesce(o, 0) AS o, ra.t * cb.t / n AS e, n, r.k AS r, s.k AS k
  FROM m ra JOIN m cb ON ra.c < cb.c JOIN k r ON r.c = ra.c JOIN k s ON s.c = cb.c CROSS JOIN n
  LEFT JOIN cells ON cells.a = ra.c AND cells.b = cb.c AND cells.va = ra.v AND cells.vb = cb.v),
chi AS (
  SELECT a, b, any_value(n) AS n, any_value(r) AS r, any_value(k) AS k,
    sum(CASE WHEN r = 2 AND k = 2 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE pow(o - e, 2) / e END) AS chi
  FROM grid GROUP BY a, b),
parts AS (
  SELECT a, b, greatest(0, chi / n - (k - 1) * (r - 1) / (n - 1)) AS p,
    least(k - (k - 1) * (k - 1) / (n - 1), r - (r - 1) * (r - 1) / (n - 1)) - 1 AS room FROM chi),
found AS (SELECT a, b, CASE WHEN room = 0 THEN 0.0 ELSE round(sqrt(p / room), 4) END AS v FROM parts)
SELECT a AS column_a, b AS column_b, v FROM found UNION ALL SELECT b, a, v FROM found UNION ALL SELECT c, c, 1.0 FROM k"""
)
def q_association_wide(spark, sf):
    """All 1,770 pairs of 60 columns."""
    return A.categorical_association(_wide(spark, sf))


_NUMBERS = [f"CASE WHEN event_id % {k + 5} <> 0 THEN (user_id * {k + 3} + event_id) % {2 * k + 17} + value END AS k{k}" for k in range(24)] + [
    f"user_id % {k} + value AS k{k}" for k in range(24, 28)
]
_NUMBERED = f"w AS (SELECT row_number() OVER () AS row, {', '.join(_NUMBERS)} FROM events)"
_FLAGS = [f"CASE WHEN event_id % {k % 7 + 2} <> 0 OR user_id % {k + 40} = 0 THEN value END AS k{k}" for k in range(28)]


@query(
    f"""WITH {_NUMBERED}, u AS (UNPIVOT w ON COLUMNS(* EXCLUDE (row)) INTO NAME c VALUE v)
SELECT x.c AS column_a, y.c AS column_b, round(corr(x.v, y.v), 4) AS r FROM u x JOIN u y ON x.row = y.row GROUP BY x.c, y.c"""
)
def q_corr_pearson_wide(spark, sf):
    """All 406 pairs of 28 columns, most of them with nulls."""
    return E.correlation_pearson(table(spark, sf, "events").selectExpr(*_NUMBERS))


@query(
    f"""WITH w AS (SELECT row_number() OVER () AS row, {', '.join(_FLAGS)} FROM events),
f AS (SELECT row, {', '.join(f'CAST(k{k} IS NULL AS INT) AS k{k}' for k in range(28))} FROM w),
u AS (UNPIVOT f ON COLUMNS(* EXCLUDE (row)) INTO NAME c VALUE v)
SELECT x.c AS column_a, y.c AS column_b, round(corr(x.v, y.v), 3) AS r FROM u x JOIN u y ON x.row = y.row AND x.c < y.c
GROUP BY x.c, y.c HAVING abs(round(corr(x.v, y.v), 3)) >= 0.5"""
)
def q_co_null_wide(spark, sf):
    """All 378 pairs of 28 columns."""
    return E.co_null_pairs(table(spark, sf, "events").selectExpr(*_FLAGS))
