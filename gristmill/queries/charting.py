"""Charts, widgets and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import charts as H, text as X
from gristmill.queries.registry import EVENTS, events_with_nulls, query, register, rounded, table

_PARTS = """p AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_name END AS p_name,
  CASE WHEN p_partkey % 2 = 0 THEN -p_retailprice ELSE p_retailprice END AS price, p_brand, p_size FROM part)"""


def _parts(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_name END AS p_name",
        "CASE WHEN p_partkey % 2 = 0 THEN -p_retailprice ELSE p_retailprice END AS price",
        "p_brand",
        "p_size",
    )


_SQL_AGG = {"sum": "sum", "mean": "avg", "count": "count", "min": "min", "max": "max"}

for _agg, _fn in _SQL_AGG.items():
    register(
        f"q_bar_{_agg}",
        lambda s, d, a=_agg: rounded(H.bar(_parts(s, d), "p_name", "price", a)),
        f"""WITH {_PARTS}, g AS (SELECT p_name AS x, round(CAST({_fn}(price) AS DOUBLE), 4) AS y FROM p WHERE p_name IS NOT NULL GROUP BY 1)
SELECT 'price' AS series, x, y, row_number() OVER (ORDER BY abs(y) DESC, x) AS rank FROM g
ORDER BY abs(y) DESC, x LIMIT 20""",
    )


@query(
    """WITH c AS (SELECT l_returnflag AS x, CAST(CASE WHEN l_returnflag = 'A' AND l_linenumber = 3 THEN 4 ELSE l_linenumber END AS VARCHAR) AS g,
  sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2),
t AS (SELECT x, row_number() OVER (ORDER BY abs(sum(y)) DESC, x) AS rank FROM c GROUP BY x),
gs AS (SELECT g FROM c GROUP BY g)
SELECT gs.g AS series, t.x, coalesce(c.y, 0.0) AS y, t.rank FROM t CROSS JOIN gs LEFT JOIN c ON c.x = t.x AND c.g = gs.g
WHERE t.rank <= 20"""
)
def q_bar_grouped(spark, sf):
    """One line number of a flag is relabelled, which leaves an empty cell to be shown as 0."""
    label = "CASE WHEN l_returnflag = 'A' AND l_linenumber = 3 THEN 4 ELSE l_linenumber END AS l_linenumber"
    lines = table(spark, sf, "lineitem").selectExpr("l_returnflag", "l_quantity", label)
    return H.bar(lines, "l_returnflag", "l_quantity", "sum", group_by="l_linenumber")


@query(
    """WITH b AS (SELECT p_brand AS x, p_name AS g, sum(p_retailprice) AS y FROM part GROUP BY 1, 2),
t AS (SELECT x, row_number() OVER (ORDER BY abs(sum(y)) DESC, x) AS rank FROM b GROUP BY x ORDER BY rank LIMIT 5),
i AS (SELECT b.*, t.rank FROM b JOIN t USING (x)),
gs AS (SELECT g FROM i GROUP BY g ORDER BY round(sum(abs(y)), 4) DESC, g LIMIT 20)
SELECT gs.g AS series, t.x, round(coalesce(i.y, 0.0), 4) AS y, t.rank FROM t CROSS JOIN gs LEFT JOIN i ON i.x = t.x AND i.g = gs.g"""
)
def q_bar_grouped_limits(spark, sf):
    return rounded(H.bar(table(spark, sf, "part"), "p_brand", "p_retailprice", "sum", 5, "p_name", max_groups=20))


@query(
    f"""WITH {EVENTS}, f AS (SELECT *, row_number() OVER (ORDER BY user_id, event_id) AS rank FROM ev WHERE user_id IS NOT NULL),
k AS (SELECT * FROM f WHERE rank <= 5000)
SELECT 'value' AS series, CAST(user_id AS VARCHAR) AS x, value AS y, rank FROM k
UNION ALL SELECT 'event_id', CAST(user_id AS VARCHAR), CAST(event_id AS DOUBLE), rank FROM k"""
)
def q_line(spark, sf):
    """The first points, as a browser asks for them."""
    return H.line(events_with_nulls(spark, sf), "user_id", ["value", "event_id"], "event_id", points=5_000)


@query(
    f"""WITH {EVENTS} SELECT 'value' AS series, CAST(user_id AS VARCHAR) AS x, value AS y,
  row_number() OVER (ORDER BY user_id, event_id) AS rank FROM ev WHERE user_id IS NOT NULL"""
)
def q_line_all(spark, sf):
    return H.line(events_with_nulls(spark, sf), "user_id", "value", "event_id")


_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LINE_HASH = "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) || ':42')"
_LINE_ORDER = f"{_LINE_HASH}, l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    f"""SELECT 'l_quantity vs l_extendedprice' AS series, l_quantity AS x, l_extendedprice AS y,
  (SELECT round(corr(l_quantity, l_extendedprice), 4) FROM lineitem) AS pearson_r
FROM lineitem ORDER BY {_LINE_ORDER} LIMIT 500"""
)
def q_scatter(spark, sf):
    return H.scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", _LINE_KEYS)


@query(
    f"""WITH k AS (SELECT l_returnflag, l_quantity, l_extendedprice,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY {_LINE_ORDER}) AS n FROM lineitem)
SELECT l_returnflag AS series, l_quantity AS x, l_extendedprice AS y,
  (SELECT round(corr(l_quantity, l_extendedprice), 4) FROM lineitem) AS pearson_r FROM k WHERE n <= 200"""
)
def q_scatter_color(spark, sf):
    lines = table(spark, sf, "lineitem")
    return H.scatter(lines, "l_quantity", "l_extendedprice", _LINE_KEYS, "l_returnflag", 200)


@query(
    """WITH r AS (SELECT min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders),
c AS (SELECT least(CAST(floor((o_custkey - lo) / ((hi - lo) / 10)) AS BIGINT), 9) AS i, count(*) AS n FROM orders, r GROUP BY 1)
SELECT 'o_custkey' AS series,
  CAST(round(lo + b.i * (hi - lo) / 10, 4) AS VARCHAR) || '–' || CAST(round(lo + (b.i + 1) * (hi - lo) / 10, 4) AS VARCHAR) AS x,
  coalesce(n, 0) AS y, b.i + 1 AS rank
FROM r CROSS JOIN (SELECT unnest(range(10)) AS i) b LEFT JOIN c ON c.i = b.i"""
)
def q_histogram(spark, sf):
    return H.histogram(table(spark, sf, "orders"), "o_custkey", 10)


@query(
    """SELECT 'sum(o_totalprice)' AS label, round(sum(o_totalprice), 2) AS value,
  printf('%.1f', sum(o_totalprice) / 1000000) || 'M' AS formatted_value FROM orders"""
)
def q_kpi(spark, sf):
    return rounded(H.kpi(table(spark, sf, "orders"), "o_totalprice"), 2)


@query(
    """SELECT 'Orders' AS label, CAST(count(o_orderstatus) AS DOUBLE) AS value,
  CAST(count(o_orderstatus) AS VARCHAR) AS formatted_value FROM orders"""
)
def q_kpi_count(spark, sf):
    return H.kpi(table(spark, sf, "orders"), "o_orderstatus", "count", "Orders")


_GROUPED = f"WITH {_PARTS}, g AS (SELECT p_name AS x, sum(price) AS y FROM p WHERE p_name IS NOT NULL GROUP BY 1), " \
    "r AS (SELECT x, y, row_number() OVER (ORDER BY round(y, 4) DESC, x) AS rank FROM g) "


@query(
    _GROUPED
    + """SELECT 'price' AS series, x, round(y, 4) AS y, rank FROM r WHERE rank <= 10
UNION ALL SELECT 'price', 'Others', round(sum(y) FILTER (rank > 10), 4), 11 FROM r HAVING count(*) > 10"""
)
def q_pie(spark, sf):
    return rounded(H.pie(_parts(spark, sf), "p_name", "price"))


@query(_GROUPED + "SELECT 'price' AS series, x, round(y, 4) AS y, rank FROM r WHERE rank <= 20")
def q_treemap(spark, sf):
    return rounded(H.treemap(_parts(spark, sf), "p_name", "price"))


_WIDGETS = [
    {"id": 1, "chart_type": "bar", "chart_params": {"x": "o_orderstatus", "y": "o_totalprice"}},
    {"id": 2, "chart_type": "kpi", "chart_params": {"value": "o_totalprice", "agg": "max"}},
    {"id": 3, "chart_type": "pie", "chart_params": {"name": "o_orderpriority", "value": "o_totalprice", "agg": "count"}},
    {"id": 4, "chart_type": "treemap", "chart_params": {"name": "o_orderpriority", "value": "o_custkey", "agg": "max"}},
    {"id": 5, "chart_type": "bar", "chart_params": {"x": "no_such_column", "y": "o_totalprice"}},
    {"id": 6, "chart_type": "text", "chart_params": {}},
]


@query(
    """WITH b AS (SELECT o_orderstatus AS x, sum(o_totalprice) AS y FROM orders GROUP BY 1),
p AS (SELECT o_orderpriority AS x, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 1),
t AS (SELECT o_orderpriority AS x, CAST(max(o_custkey) AS DOUBLE) AS y FROM orders GROUP BY 1)
SELECT '1' AS widget_id, 'o_totalprice' AS series, x, round(y, 2) AS y, row_number() OVER (ORDER BY abs(y) DESC, x) AS rank FROM b
UNION ALL SELECT '2', 'max(o_totalprice)', printf('%.1f', max(o_totalprice) / 1000) || 'K', round(max(o_totalprice), 2), 1 FROM orders
UNION ALL SELECT '3', 'o_totalprice', x, y, row_number() OVER (ORDER BY y DESC, x) FROM p
UNION ALL SELECT '4', 'o_custkey', x, y, row_number() OVER (ORDER BY y DESC, x) FROM t"""
)
def q_render_widgets(spark, sf):
    rows, _ = H.render_widgets(table(spark, sf, "orders"), _WIDGETS)
    return rounded(rows, 2)


# --- text tables -----------------------------------------------------------------------


@query(
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, count(*) AS turns,
  string_agg(CASE WHEN lower(role) = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn) AS history
FROM k WHERE n <= 3 GROUP BY conv_id"""
)
def q_history_window(spark, sf):
    return X.history_window(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", 3)


_QUESTIONS = (
    "CASE WHEN turn % 2 = 0 THEN concat('Intro', {nl}, 'Q1: How many ', role, '?', {nl}, '  Q2. how MANY ', role, '?', {nl}, "
    "'Q3: Turn ', CAST(turn AS {text}), ' ', substr(role, 1, 2), {nl}, 'q4: not a question') ELSE text END"
)


@query(
    f"""WITH t AS (SELECT conv_id, turn, {_QUESTIONS.format(nl='chr(10)', text='VARCHAR')} AS body FROM conversations),
l AS (SELECT conv_id, turn, unnest(string_split_regex(body, '\\r\\n|\\r|\\n')) AS line,
             generate_subscripts(string_split_regex(body, '\\r\\n|\\r|\\n'), 1) - 1 AS position FROM t),
q AS (SELECT conv_id, turn, position, regexp_extract(line, '^\\s*Q\\d+[.:]\\s*(.+?)\\s*$', 1) AS question FROM l
      WHERE regexp_matches(line, '^\\s*Q\\d+[.:]\\s*(.+?)\\s*$')),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(question) ORDER BY position) AS n FROM q)
SELECT conv_id, turn, CAST(position AS BIGINT) AS position, question FROM r WHERE n = 1"""
)
def q_parse_numbered_lines(spark, sf):
    body = F.expr(_QUESTIONS.format(nl="char(10)", text="STRING"))
    talks = table(spark, sf, "conversations").select("conv_id", "turn", body.alias("body"))
    return X.parse_numbered_lines(talks, ["conv_id", "turn"], "body")
