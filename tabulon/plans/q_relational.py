"""Relational queries (R5–R27) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import relational as rel
from tabulon.plans.registry import query
from tabulon.sources.tables import read_table as T


@query("group_sum", """
SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sum_price, count(*) AS n_lines
FROM lineitem GROUP BY l_returnflag ORDER BY sum_price DESC""")
def group_sum(spark, d):
    li = T(spark, d, "lineitem")
    return (li.groupBy("l_returnflag")
            .agg(F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.count(F.lit(1)).alias("n_lines"))
            .orderBy(F.desc("sum_price")))


@query("computed_pct_change", """
SELECT l_orderkey, l_linenumber,
       round((l_extendedprice * (1 - l_discount) - l_extendedprice) / l_extendedprice * 100, 2) AS pct_change
FROM lineitem""")
def computed_pct_change(spark, d):
    li = T(spark, d, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    pct = F.try_divide(net - F.col("l_extendedprice"), F.col("l_extendedprice")) * 100
    return li.select("l_orderkey", "l_linenumber", F.round(pct, 2).alias("pct_change"))


@query("like_filter", """
SELECT event_id, event_type, value FROM events WHERE event_type LIKE '%ur%' AND value > 5""")
def like_filter(spark, d):
    ev = T(spark, d, "events")
    return ev.filter(F.col("event_type").like("%ur%") & (F.col("value") > 5)).select(
        "event_id", "event_type", "value")


@query("quarter_avg", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(quarter(o_orderdate) AS INTEGER) AS qtr,
       strftime(CAST(date_trunc('quarter', CAST(o_orderdate AS DATE)) AS DATE), '%Y-%m-%d') AS quarter_start,
       round(avg(o_totalprice), 2) AS avg_total, count(*) AS n_orders
FROM orders GROUP BY ALL ORDER BY yr, qtr""")
def quarter_avg(spark, d):
    o = T(spark, d, "orders")
    day = F.to_date("o_orderdate")
    return (o.groupBy(F.year(day).alias("yr"), F.quarter(day).alias("qtr"),
                      F.date_format(F.date_trunc("quarter", day), "yyyy-MM-dd").alias("quarter_start"))
            .agg(F.round(F.avg("o_totalprice"), 2).alias("avg_total"), F.count(F.lit(1)).alias("n_orders"))
            .orderBy("yr", "qtr"))


@query("having_distinct", """
SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_dates, count(*) AS n_orders
FROM orders GROUP BY o_custkey HAVING count(DISTINCT CAST(o_orderdate AS DATE)) > 10""")
def having_distinct(spark, d):
    o = T(spark, d, "orders")
    return (o.groupBy("o_custkey")
            .agg(F.count_distinct(F.to_date("o_orderdate")).alias("n_dates"), F.count(F.lit(1)).alias("n_orders"))
            .filter(F.col("n_dates") > 10))


_GSET_SQL = """
SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS INTEGER) AS gid,
       round(sum(l_quantity), 2) AS sum_qty, count(*) AS n_lines
FROM lineitem GROUP BY {g}"""


def _gsets(kind):
    def build(spark, d):
        li = T(spark, d, "lineitem")
        aggs = [F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count(F.lit(1)).alias("n_lines")]
        if kind == "rollup":
            g = li.rollup("l_returnflag", "l_linestatus")
        elif kind == "cube":
            g = li.cube("l_returnflag", "l_linestatus")
        else:
            li.createOrReplaceTempView("_li_gs")
            return spark.sql("""
                SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS INT) AS gid,
                       round(sum(l_quantity), 2) AS sum_qty, count(*) AS n_lines
                FROM _li_gs GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
        return g.agg(F.grouping_id("l_returnflag", "l_linestatus").cast("int").alias("gid"), *aggs)
    return build


query("rollup_sum", _GSET_SQL.format(g="ROLLUP (l_returnflag, l_linestatus)"))(_gsets("rollup"))
query("cube_sum", _GSET_SQL.format(g="CUBE (l_returnflag, l_linestatus)"))(_gsets("cube"))
query("grouping_sets_sum", _GSET_SQL.format(g="GROUPING SETS ((l_returnflag), (l_linestatus), ())"))(_gsets("sets"))


@query("top_customers", """
SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n_orders
FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 10""")
def top_customers(spark, d):
    o = T(spark, d, "orders")
    return (o.groupBy("o_custkey")
            .agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n_orders"))
            .orderBy(F.desc("total"), "o_custkey").limit(10))


@query("rank_in_group", """
SELECT * FROM (
  SELECT p_brand, p_partkey, p_retailprice,
         CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rn,
         CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS INTEGER) AS price_rank,
         CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS INTEGER) AS price_dense_rank
  FROM part) t
WHERE rn <= 3""")
def rank_in_group(spark, d):
    p = T(spark, d, "part")
    from pyspark.sql import Window
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"))
    top = rel.top_k_per_group(p, ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 3)
    return top.select("p_brand", "p_partkey", "p_retailprice", "rn",
                      F.rank().over(w).alias("price_rank"), F.dense_rank().over(w).alias("price_dense_rank"))


@query("running_total", """
SELECT ym, round(total, 2) AS total,
       round(sum(total) OVER (ORDER BY ym ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS ym, sum(o_totalprice) AS total FROM orders GROUP BY 1) m""")
def running_total(spark, d):
    o = T(spark, d, "orders")
    m = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(F.sum("o_totalprice").alias("total"))
    # One row per month: the unpartitioned window sees a few hundred rows at any scale.
    r = rel.running_total(m, "ym", "total")
    return r.select("ym", F.round("total", 2).alias("total"), F.round("running_total", 2).alias("running_total"))


@query("rolling_avg", """
SELECT event_type, day, round(daily_value, 2) AS daily_value,
       round(avg(daily_value) OVER (PARTITION BY event_type ORDER BY day
                                    ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling_avg_7
FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, sum(value) AS daily_value
      FROM events GROUP BY 1, 2) t""")
def rolling_avg(spark, d):
    ev = T(spark, d, "events")
    daily = ev.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.sum("value").alias("daily_value"))
    r = rel.rolling_mean(daily, "day", "daily_value", 7, ["event_type"], "rolling_avg_7")
    return r.select("event_type", "day", F.round("daily_value", 2).alias("daily_value"),
                    F.round("rolling_avg_7", 4).alias("rolling_avg_7"))


@query("share_of_total", """
SELECT c_mktsegment, round(revenue, 2) AS revenue, round(revenue / sum(revenue) OVER () * 100, 4) AS share_pct
FROM (SELECT c_mktsegment, sum(o_totalprice) AS revenue
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) t""")
def share_of_total(spark, d):
    o, c = T(spark, d, "orders"), T(spark, d, "customer")
    seg = (_orders_by_customer(o).join(c, F.col("o_custkey") == c.c_custkey).groupBy("c_mktsegment")
           .agg(F.sum("revenue").alias("revenue")))
    s = rel.share_of_total(seg, "revenue")
    return s.select("c_mktsegment", F.round("revenue", 2).alias("revenue"), F.round("share_pct", 4).alias("share_pct"))


@query("year_over_year", """
WITH m AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mo,
                  sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT a.yr, a.mo, round(a.total, 2) AS total, round(b.total, 2) AS prev_year_total,
       round((a.total - b.total) / b.total * 100, 2) AS yoy_pct
FROM m a LEFT JOIN m b ON b.yr = a.yr - 1 AND b.mo = a.mo""")
def year_over_year(spark, d):
    o = T(spark, d, "orders")
    m = o.groupBy(F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo")).agg(
        F.sum("o_totalprice").alias("total"))
    j = rel.period_over_period(m, ["mo"], "yr", "total", 1, "prev")
    return j.select("yr", "mo", F.round("total", 2).alias("total"), F.round("prev", 2).alias("prev_year_total"),
                    F.round(F.try_divide(F.col("total") - F.col("prev"), F.col("prev")) * 100, 2).alias("yoy_pct"))


@query("declining_brands", """
WITH m AS (SELECT p_brand, year(l_shipdate) * 12 + month(l_shipdate) AS month_idx,
                  sum(l_extendedprice * (1 - l_discount)) AS revenue
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, round(regr_slope(revenue, month_idx), 4) AS slope, count(*) AS n_months
FROM m GROUP BY p_brand HAVING regr_slope(revenue, month_idx) < 0""")
def declining_brands(spark, d):
    li, p = T(spark, d, "lineitem"), T(spark, d, "part")
    # Revenue per part and month before the join: a part with a third of all lines
    # collapses map-side.
    per_part = (li.groupBy("l_partkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month_idx"))
                .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")))
    m = (per_part.join(p, F.col("l_partkey") == p.p_partkey).groupBy("p_brand", "month_idx")
         .agg(F.sum("revenue").alias("revenue")))
    s = rel.trend_slope(m, ["p_brand"], "month_idx", "revenue")
    return s.filter(F.col("slope") < 0).select("p_brand", F.round("slope", 4).alias("slope"),
                                               F.col("n_points").alias("n_months"))


@query("join_star", """
SELECT r_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def join_star(spark, d):
    o, c, n, r = (T(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    geo = _geo(n, r)
    cust = c.select("c_custkey", "c_nationkey").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    return (_orders_by_customer(o).join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("r_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"),
                                   F.sum("n_orders").alias("n_orders")))


def _geo(n, r):
    """nation ⋈ region; the join strategy is left to the measured sizes."""
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")


def _orders_by_customer(o):
    """Order totals and counts per customer before the fact ⋈ customer join:
    the partial aggregate collapses a customer's orders map-side, so a
    customer holding a third of all orders ships one row per task, not a
    third of the table into one join task."""
    return o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("revenue"),
                                      F.count(F.lit(1)).alias("n_orders"))


_RECENT = "2001-07-01"


@query("join_left", f"""
SELECT c_custkey, count(o_orderkey) AS n_recent_orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '{_RECENT}'
GROUP BY c_custkey""")
def join_left(spark, d):
    c, o = T(spark, d, "customer"), T(spark, d, "orders")
    recent = o.filter(F.col("o_orderdate") >= F.lit(_RECENT).cast("timestamp_ntz"))
    # Recent orders counted per customer before the join (a hot customer
    # collapses map-side); customers without one get 0.
    per_cust = recent.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return (c.select("c_custkey").join(per_cust, F.col("c_custkey") == F.col("o_custkey"), "left")
            .groupBy("c_custkey").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_recent_orders")))


@query("join_semi", f"""
SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '{_RECENT}')""")
def join_semi(spark, d):
    c, o = T(spark, d, "customer"), T(spark, d, "orders")
    # Semi and anti joins ignore repeats on the right: distinct keys first, so
    # a customer with a third of all orders collapses map-side.
    recent = o.filter(F.col("o_orderdate") >= F.lit(_RECENT).cast("timestamp_ntz")).select("o_custkey").distinct()
    return c.join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("join_anti", f"""
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '{_RECENT}')""")
def join_anti(spark, d):
    c, o = T(spark, d, "customer"), T(spark, d, "orders")
    recent = o.filter(F.col("o_orderdate") >= F.lit(_RECENT).cast("timestamp_ntz")).select("o_custkey").distinct()
    return c.join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("join_theta", """
SELECT l_orderkey, l_linenumber, CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) AS days_to_ship
FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY""")
def join_theta(spark, d):
    li, o = T(spark, d, "lineitem"), T(spark, d, "orders")
    # Equi key plus a non-equi condition: a sort-merge join on the key, the
    # inequality evaluated per matched pair (no pair explosion beyond the key).
    cond = (li.l_orderkey == o.o_orderkey) & (li.l_shipdate > o.o_orderdate + F.expr("INTERVAL 60 DAYS"))
    return li.join(o, cond).select("l_orderkey", "l_linenumber",
                                   F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days_to_ship"))


@query("region_segment_grid", """
SELECT r_name, c_mktsegment, round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment""")
def region_segment_grid(spark, d):
    o, c, n, r = (T(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    cust = c.select("c_custkey", "c_nationkey", "c_mktsegment").join(
        _geo(n, r), F.col("c_nationkey") == F.col("n_nationkey"))
    return (_orders_by_customer(o).join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("r_name", "c_mktsegment").agg(F.round(F.sum("revenue"), 2).alias("revenue"),
                                                   F.sum("n_orders").alias("n_orders")))


def _nations(spark, d, above=None):
    c, s = T(spark, d, "customer"), T(spark, d, "supplier")
    if above is not None:
        c, s = c.filter(F.col("c_acctbal") > above), s.filter(F.col("s_acctbal") > above)
    return c.select(F.col("c_nationkey").alias("nationkey")), s.select(F.col("s_nationkey").alias("nationkey"))


@query("union_all", """
SELECT c_nationkey AS nationkey FROM customer
UNION ALL SELECT s_nationkey AS nationkey FROM supplier""")
def union_all(spark, d):
    c, s = _nations(spark, d)
    return c.unionByName(s)


@query("intersect", """
SELECT c_nationkey AS nationkey FROM customer
INTERSECT SELECT s_nationkey AS nationkey FROM supplier""")
def intersect(spark, d):
    c, s = _nations(spark, d)
    return c.intersect(s)


@query("except", """
SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 8000
EXCEPT SELECT s_nationkey AS nationkey FROM supplier WHERE s_acctbal > 8000""")
def except_(spark, d):
    # Rich customers' nations without a rich supplier (over all rows the result is empty).
    c, s = _nations(spark, d, 8000)
    return c.subtract(s)


@query("cte_subquery", """
WITH a AS (SELECT o_custkey AS k, avg(o_totalprice) AS avg_total FROM orders GROUP BY o_custkey)
SELECT o_orderkey, o_custkey, o_totalprice FROM orders JOIN a ON o_custkey = k WHERE o_totalprice > avg_total""")
def cte_subquery(spark, d):
    # One average per customer joins back; a customer with many orders is split by
    # the skew join, the averages' side having one row for it.
    return rel.run_query(spark, {"orders_cte": T(spark, d, "orders")}, """
        WITH a AS (SELECT o_custkey AS k, avg(o_totalprice) AS avg_total FROM orders_cte GROUP BY o_custkey)
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders_cte o JOIN a ON a.k = o.o_custkey
        WHERE o_totalprice > avg_total""")


@query("join_right", """
SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey""")
def join_right(spark, d):
    o, c = T(spark, d, "orders").select("o_custkey", "o_orderkey"), T(spark, d, "customer").select("c_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


@query("join_full", """
SELECT n.k AS nation_key, n.n_customers, s.n_suppliers
FROM (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 0 GROUP BY 1) n
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) s
ON n.k = s.k""")
def join_full(spark, d):
    n = (T(spark, d, "customer").filter(F.col("c_acctbal") > 0).groupBy(F.col("c_nationkey").alias("nk"))
         .agg(F.count(F.lit(1)).alias("n_customers")))
    s = (T(spark, d, "supplier").filter(F.col("s_acctbal") > 8000).groupBy(F.col("s_nationkey").alias("sk"))
         .agg(F.count(F.lit(1)).alias("n_suppliers")))
    return n.join(s, F.col("nk") == F.col("sk"), "full").select(
        F.col("nk").alias("nation_key"), "n_customers", "n_suppliers")


@query("pivot_flags", """
SELECT l_returnflag,
       round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2) AS "F",
       round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS "O"
FROM lineitem GROUP BY l_returnflag""")
def pivot_flags(spark, d):
    li = T(spark, d, "lineitem")
    pv = rel.pivot_sum(li, "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity")
    return pv.select("l_returnflag", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


@query("date_shift", """
SELECT o_orderkey, strftime(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE), '%Y-%m-%d') AS next_day
FROM orders""")
def date_shift(spark, d):
    o = T(spark, d, "orders")
    return o.select("o_orderkey", F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "yyyy-MM-dd").alias("next_day"))


@query("list_by_key", """
SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS sizes
FROM part GROUP BY p_brand""")
def list_by_key(spark, d):
    p = T(spark, d, "part")
    return rel.list_agg(p, ["p_brand"], "p_size").withColumnRenamed("values", "sizes")


@query("segment_vs_overall", """
SELECT c_mktsegment, round(avg(o_totalprice), 4) AS segment_avg,
       round((SELECT avg(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey), 4) AS overall_avg,
       round(avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey), 4) AS diff
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def segment_vs_overall(spark, d):
    o, c = T(spark, d, "orders"), T(spark, d, "customer")
    per_cust = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("o_totalprice"),
                                          F.count("o_totalprice").alias("n"))
    j = per_cust.join(c, F.col("o_custkey") == c.c_custkey).select("c_mktsegment", "o_totalprice", "n")
    s = rel.segment_vs_overall(j, "c_mktsegment", "o_totalprice", count_col="n")
    return s.select("c_mktsegment", *[F.round(x, 4).alias(x) for x in ("segment_avg", "overall_avg", "diff")])


@query("sql_transform", """
SELECT o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY total DESC""")
def sql_transform_q(spark, d):
    o = T(spark, d, "orders")
    return rel.sql_transform(spark, o, """
        SELECT o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
        FROM input_data WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY total DESC""")


@query("parse_date_text", """
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS date_text,
       strftime(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y'), '%Y-%m-%d') AS parsed FROM orders""")
def parse_date_text(spark, d):
    """Dates as text in a day-first format, parsed back with that format."""
    o = T(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("date_text"))
    return o.select("o_orderkey", "date_text",
                    F.date_format(F.try_to_timestamp("date_text", F.lit("dd/MM/yyyy")), "yyyy-MM-dd").alias("parsed"))
