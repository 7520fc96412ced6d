"""Chart-data queries (C1–C15) on orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import chartdata as cd
from tabulon.plans.registry import query
from tabulon.sources.tables import read_table as T


def _r(df, cols, k=2):
    return df.select(*[F.round(c, k).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("chart_bar", """
SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice
FROM orders GROUP BY 1, 2""")
def chart_bar(spark, d):
    o = T(spark, d, "orders")
    return _r(cd.chart_data(o, "bar", "o_orderpriority", "o_totalprice", "o_orderstatus"), ["o_totalprice"])


@query("chart_line", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS o_totalprice
FROM orders GROUP BY 1 ORDER BY 1""")
def chart_line(spark, d):
    o = T(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return _r(cd.chart_data(o, "line", "month", "o_totalprice"), ["o_totalprice"])


@query("chart_scatter", """
SELECT l_quantity, l_extendedprice, l_returnflag, l_discount FROM lineitem""")
def chart_scatter(spark, d):
    li = T(spark, d, "lineitem")
    return cd.chart_data(li, "scatter", "l_quantity", "l_extendedprice", "l_returnflag", "l_discount")


@query("chart_area", """
WITH a AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderpriority, sum(o_totalprice) AS o_totalprice
           FROM orders GROUP BY 1, 2)
SELECT yr, o_orderpriority, round(o_totalprice, 2) AS o_totalprice,
       round(sum(o_totalprice) OVER (PARTITION BY yr ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - o_totalprice, 2) AS y0,
       round(sum(o_totalprice) OVER (PARTITION BY yr ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS y1
FROM a""")
def chart_area(spark, d):
    o = T(spark, d, "orders").withColumn("yr", F.year("o_orderdate"))
    return _r(cd.chart_data(o, "area", "yr", "o_totalprice", "o_orderpriority"), ["o_totalprice", "y0", "y1"])


@query("chart_pie", """
WITH a AS (SELECT c_mktsegment, sum(o_totalprice) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c_mktsegment, round(o_totalprice, 2) AS o_totalprice, round(o_totalprice / (SELECT sum(o_totalprice) FROM a), 6) AS share FROM a""")
def chart_pie(spark, d):
    o, c = T(spark, d, "orders"), T(spark, d, "customer")
    # Order totals per customer first: a customer with a third of all orders
    # collapses map-side before the join (the pie sums the partial sums).
    per_cust = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("o_totalprice"))
    j = per_cust.join(c, F.col("o_custkey") == c.c_custkey).select("c_mktsegment", "o_totalprice")
    p = cd.chart_data(j, "pie", "c_mktsegment", "o_totalprice")
    return _r(_r(p, ["o_totalprice"]), ["share"], 6)


@query("chart_heatmap", """
SELECT CAST(hour(ts) AS INTEGER) AS hour, event_type, count(*) AS value FROM events GROUP BY 1, 2""")
def chart_heatmap(spark, d):
    ev = T(spark, d, "events").withColumn("hour", F.hour("ts"))
    return cd.chart_data(ev, "heatmap", "hour", "event_type")


@query("chart_heatmap_avg", """
SELECT CAST(hour(ts) AS INTEGER) AS hour, event_type, round(avg(value), 6) AS value FROM events GROUP BY 1, 2""")
def chart_heatmap_avg(spark, d):
    ev = T(spark, d, "events").withColumn("hour", F.hour("ts"))
    return _r(cd.chart_data(ev, "heatmap", "hour", "event_type", color="value", agg="avg"), ["value"], 6)


@query("value_counts", """
SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL
GROUP BY 1 ORDER BY count DESC, event_type LIMIT 10""")
def value_counts(spark, d):
    return cd.value_counts(T(spark, d, "events"), "event_type", 10)


@query("value_counts_users", """
SELECT user_id, count(*) AS count FROM events WHERE user_id IS NOT NULL
GROUP BY 1 ORDER BY count DESC, user_id LIMIT 10""")
def value_counts_users(spark, d):
    return cd.value_counts(T(spark, d, "events"), "user_id", 10)


_NICE_SQL = """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL),
sp AS (SELECT lo, hi, coalesce(nullif(hi - lo, 0), nullif(abs(lo), 0), 1.0) AS span FROM s),
s0 AS (SELECT *, power(10.0, floor(log10(span) + 0.5) - 1) AS st0 FROM sp),
s1 AS (SELECT *, CASE WHEN ceil(span / st0) <= 10 THEN st0 WHEN ceil(span / (st0 * 10)) <= 10 THEN st0 * 10
                      WHEN ceil(span / (st0 * 100)) <= 10 THEN st0 * 100 ELSE st0 * 1000 END AS st1 FROM s0),
s2 AS (SELECT *, CASE WHEN span / (st1 / 5) <= 10 THEN st1 / 5 ELSE st1 END AS st2 FROM s1),
s3 AS (SELECT *, CASE WHEN span / (st2 / 2) <= 10 THEN st2 / 2 ELSE st2 END AS step FROM s2),
s4 AS (SELECT *, CASE WHEN ln(step) >= 0 THEN 0 ELSE CAST(floor(-ln(step) / ln(10)) AS INTEGER) + 1 END AS prec FROM s3),
s5 AS (SELECT *, floor(lo / step + power(10.0, -prec - 1)) * step AS v FROM s4),
b AS (SELECT CASE WHEN lo < v THEN v - step ELSE v END AS start, step FROM s5)
SELECT start + k * step AS bin_start, start + (k + 1) * step AS bin_end, count(*) AS count
FROM (SELECT floor((value - start) / step) AS k, start, step FROM events, b WHERE value IS NOT NULL) t
GROUP BY k, start, step"""


@query("auto_histogram", _NICE_SQL)
def auto_histogram(spark, d):
    """Nice bins of ``events.value`` (bounds decide the step)."""
    return cd.auto_histogram(T(spark, d, "events"), "value")


@query("auto_chart", """
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 1 LIMIT 20""")
def auto_chart(spark, d):
    o = T(spark, d, "orders")
    res = o.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    _, data = cd.auto_chart(res)
    return data


@query("auto_chart_scatter", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey, o_totalprice LIMIT 100""")
def auto_chart_scatter(spark, d):
    kind, data = cd.auto_chart(T(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    assert kind == "scatter"
    return data


@query("auto_chart_histogram", _NICE_SQL)
def auto_chart_histogram(spark, d):
    kind, data = cd.auto_chart(T(spark, d, "events").select("value"))
    assert kind == "histogram"
    return data


@query("auto_chart_values", """
SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1
ORDER BY count DESC, event_type LIMIT 10""")
def auto_chart_values(spark, d):
    kind, data = cd.auto_chart(T(spark, d, "events").select("event_type"))
    assert kind == "bar"
    return data


@query("auto_chart_default", """
SELECT o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderpriority, o_orderstatus, o_orderkey LIMIT 20""")
def auto_chart_default(spark, d):
    kind, data = cd.auto_chart(T(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_orderkey"))
    assert kind == "bar"
    return data


@query("one_chart_list", """
SELECT CAST(1 AS INTEGER) AS idx, 'Rows: ' || count(*) AS title, 'line:day:n' AS image, 'Line visualization' AS description
FROM events""")
def one_chart_list(spark, d):
    n = T(spark, d, "events").count()
    return cd.one_chart_list(spark, "line:day:n", "line", f"Rows: {n}")


def _bonus(goal: str, words: tuple[str, ...], points: int = 10) -> str:
    goal_sql = "'" + goal.lower().replace("'", "''") + "'"
    return "CASE WHEN " + " OR ".join(f"contains({goal_sql}, '{w}')" for w in words) + f" THEN {points} ELSE 0 END"


def _recommend_sql(goal: str) -> str:
    """C12 rules in DuckDB over the per-column field types of orders."""
    from tabulon.plans.q_profile import ORDERS
    return "WITH " + recommend_ctes(goal, "orders", ORDERS)


def recommend_ctes(goal: str, table: str, cols) -> str:
    """C12 rules as DuckDB CTEs (ending in ``titled``) over ``table``, whose
    columns are given as (name, type, semantic class)."""
    from tabulon.plans.q_profile import _field_types_sql
    ints = ", ".join(f"('{c}', {str(dt in ('tinyint', 'smallint', 'int', 'bigint')).lower()})"
                     for c, dt, _ in cols)
    return f"""
meta AS ({_field_types_sql(table, cols)}),
f AS (SELECT m.*, (suffix(lower(m.column_name), 'id') OR suffix(lower(m.column_name), 'key')
                   OR (d.is_int AND m.n_unique = m.n_rows)) AS ident
      FROM meta m JOIN (VALUES {ints}) d(column_name, is_int) ON m.column_name = d.column_name),
qn AS (SELECT column_name, row_number() OVER (ORDER BY position) AS r FROM f
       WHERE field_type = 'quantitative' AND NOT ident),
tm AS (SELECT column_name, row_number() OVER (ORDER BY position) AS r FROM f WHERE field_type = 'temporal'),
sm AS (SELECT column_name, n_unique, row_number() OVER (ORDER BY n_unique, column_name) AS r FROM f
       WHERE field_type IN ('nominal', 'ordinal') AND n_unique > 1 AND n_unique <= 50),
k AS (SELECT (SELECT column_name FROM qn WHERE r = 1) AS q1, (SELECT column_name FROM qn WHERE r = 2) AS q2,
             (SELECT column_name FROM qn WHERE r = 3) AS q3, (SELECT column_name FROM tm WHERE r = 1) AS t1,
             (SELECT column_name FROM sm WHERE r = 1) AS s1, (SELECT column_name FROM sm WHERE r = 2) AS s2,
             (SELECT column_name FROM sm WHERE r > 1 AND n_unique <= 10 ORDER BY r LIMIT 1) AS bar_color,
             (SELECT column_name FROM sm WHERE n_unique <= 7 ORDER BY r LIMIT 1) AS pie_x),
specs AS (
  SELECT 90 + {_bonus(goal, ("trend", "time", "over"))} AS score, 'line' AS chart_type, t1 AS x_field, q1 AS y_field,
         CASE WHEN s1 <> t1 THEN s1 END AS color_field, CAST(NULL AS VARCHAR) AS size_field,
         'Shows how ' || q1 || ' changes over ' || t1 || '.' AS reason FROM k WHERE t1 IS NOT NULL AND q1 IS NOT NULL
  UNION ALL
  SELECT 85 + {_bonus(goal, ("compare", "rank", "top", "categor"))}, 'bar', s1, q1, bar_color, NULL,
         'Compares ' || q1 || ' across ' || s1 || ' categories.' FROM k WHERE s1 IS NOT NULL AND q1 IS NOT NULL
  UNION ALL
  SELECT 80 + {_bonus(goal, ("correl", "relationship", "versus", "vs"))}, 'scatter', q1, q2, s1, q3,
         'Shows the relationship between ' || q1 || ' and ' || q2 || '.' FROM k WHERE q2 IS NOT NULL
  UNION ALL
  SELECT 70 + {_bonus(goal, ("share", "proportion", "part"))}, 'pie', pie_x, q1, NULL, NULL,
         'Shows each ' || pie_x || chr(39) || 's share of total ' || q1 || '.'
  FROM k WHERE pie_x IS NOT NULL AND q1 IS NOT NULL
  UNION ALL
  SELECT 60, 'heatmap', s1, s2, q1, NULL, 'Shows ' || q1 || ' across ' || s1 || ' and ' || s2 || '.'
  FROM k WHERE s2 IS NOT NULL AND q1 IS NOT NULL),
recs AS (SELECT chart_type, x_field, y_field, color_field, size_field, reason,
                CAST(row_number() OVER (ORDER BY score DESC, chart_type) AS INTEGER) AS priority
         FROM specs QUALIFY priority <= 3),
titled AS (SELECT *, substr(upper(chart_type[1]) || lower(chart_type[2:]) || ' of ' || y_field || ' by ' || x_field,
                            1, 80) AS title FROM recs)"""


_GOAL_RECOMMEND = "compare totals across priorities"
_GOAL_CHECKS = "trend over time"


@query("recommend_charts", _recommend_sql(_GOAL_RECOMMEND) + " SELECT * EXCLUDE (title) FROM titled")
def recommend_charts(spark, d):
    """Ranked specs for orders (types and cardinality from one job)."""
    o = T(spark, d, "orders")
    return cd.recommend_charts(o, _GOAL_RECOMMEND)


@query("chart_checks", _recommend_sql(_GOAL_CHECKS) + " SELECT * FROM titled")
def chart_checks(spark, d):
    o = T(spark, d, "orders")
    return cd.spec_title(cd.chart_checks(cd.recommend_charts(o, _GOAL_CHECKS)))


@query("chart_list", _recommend_sql("") + """
SELECT priority AS idx, title, chart_type || ':' || x_field || ':' || y_field AS image,
       upper(chart_type[1]) || lower(chart_type[2:]) || ' visualization' AS description FROM titled""")
def chart_list(spark, d):
    """The chart list built from the recommendations, one image
    reference per spec (the chart-data query that would be drawn)."""
    o = T(spark, d, "orders")
    recs = cd.spec_title(cd.chart_checks(cd.recommend_charts(o)))
    charts = recs.select(F.col("priority").alias("idx"), "title",
                         F.concat_ws(":", "chart_type", "x_field", "y_field").alias("image"),
                         F.concat(F.initcap("chart_type"), F.lit(" visualization")).alias("description"))
    return cd.chart_list(charts)


@query("stream_window_counts", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       count(*) AS n_events, round(sum(value), 6) AS value_sum, count(*) FILTER (WHERE value IS NULL) AS n_missing
FROM events GROUP BY 1, 2""")
def stream_window_counts(spark, d):
    """Hourly event counts per type, computed by a Structured Streaming query
    over the events files (watermarked state, update mode, batch sink)."""
    from tabulon.plans.flows import shared_scratch
    from tabulon.streaming.windows import run_windowed_counts
    schema = T(spark, d, "events").schema
    base = shared_scratch(spark, "stream")
    out = run_windowed_counts(spark, f"{d.rstrip('/')}/events*.parquet", schema, f"{base}/sink", f"{base}/state")
    return out.withColumn("value_sum", F.round("value_sum", 6))
