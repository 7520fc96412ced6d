"""Function-transform and ML queries (U1–U7) on lineitem, customer, embeddings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tabulon.operators import ml, udf
from tabulon.plans.registry import query
from tabulon.sources.tables import read_table as T


def revenue_by_flag(df):
    """A caller's transform_data: Spark columns only."""
    return (df.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
            .groupBy("l_returnflag").agg(F.round(F.sum("net"), 2).alias("net_revenue"),
                                         F.count(F.lit(1)).alias("n_lines")))


@query("fn_transform", """
SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net_revenue, count(*) AS n_lines
FROM lineitem GROUP BY l_returnflag""")
def fn_transform(spark, d):
    return udf.function_transform(T(spark, d, "lineitem"), revenue_by_flag)


def per_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per order, of all lines of many orders."""
    net = pdf["l_extendedprice"] * (1 - pdf["l_discount"])
    lines = net.groupby(pdf["l_orderkey"], sort=False, dropna=False)
    total = lines.sum()
    return pd.DataFrame({"l_orderkey": total.index, "n_lines": lines.size().to_numpy(), "order_net": total.to_numpy(),
                         "max_line_share": (lines.max() / total).where(total != 0).to_numpy()})


# Rows per packed applyInPandas group: bounded memory per Python worker call.
PACK_ROWS = 200_000


@query("fn_grouped", """
SELECT l_orderkey, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 6) AS order_net,
       round(max(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice * (1 - l_discount)), 6) AS max_line_share
FROM lineitem GROUP BY l_orderkey""")
def fn_grouped(spark, d):
    """U2 per order: an order's lines are a bounded group (at most seven)."""
    li = T(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    g = udf.grouped_function(li, ["l_orderkey"], per_order,
                             "l_orderkey long, n_lines long, order_net double, max_line_share double",
                             pack_rows=PACK_ROWS, many_groups=True)
    return g.select("l_orderkey", "n_lines", F.round("order_net", 6).alias("order_net"),
                    F.round("max_line_share", 6).alias("max_line_share"))


def _flag_partial(pdf: pd.DataFrame) -> pd.DataFrame:
    net = pdf["l_extendedprice"] * (1 - pdf["l_discount"])
    return pd.DataFrame({"l_returnflag": [pdf["l_returnflag"].iloc[0]], "s": [float(net.sum())],
                         "n": [len(pdf)]})


def _flag_final(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"l_returnflag": [pdf["l_returnflag"].iloc[0]],
                         "net_revenue": [float(pdf["s"].sum())], "n_lines": [int(pdf["n"].sum())]})


@query("fn_grouped_salted", """
SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net_revenue, count(*) AS n_lines
FROM lineitem GROUP BY l_returnflag""")
def fn_grouped_salted(spark, d):
    """U2 on a hot key (three flags hold all rows): salted partial + merge."""
    li = T(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_discount")
    g = udf.grouped_function(li, ["l_returnflag"], _flag_final, "l_returnflag string, net_revenue double, n_lines long",
                             partial=_flag_partial, partial_schema="l_returnflag string, s double, n long")
    return g.select("l_returnflag", F.round("net_revenue", 2).alias("net_revenue"), "n_lines")


def price_band(pdf: pd.DataFrame) -> pd.DataFrame:
    net = pdf["l_extendedprice"] * (1 - pdf["l_discount"])
    band = pd.cut(net, [-float("inf"), 10000, 50000, float("inf")], labels=["low", "mid", "high"], right=False)
    return pd.DataFrame({"l_orderkey": pdf["l_orderkey"], "l_linenumber": pdf["l_linenumber"],
                         "net": net, "band": band.astype(str)})


@query("fn_batch", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net,
       CASE WHEN l_extendedprice * (1 - l_discount) < 10000 THEN 'low'
            WHEN l_extendedprice * (1 - l_discount) < 50000 THEN 'mid' ELSE 'high' END AS band
FROM lineitem""")
def fn_batch(spark, d):
    li = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    b = udf.batch_function(li, price_band, "l_orderkey long, l_linenumber int, net double, band string")
    return b.select("l_orderkey", "l_linenumber", F.round("net", 6).alias("net"), "band")


@query("scale_columns", """
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, min(l_quantity) AS lq, max(l_quantity) AS hq,
                  avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp, min(l_extendedprice) AS lp,
                  max(l_extendedprice) AS hp FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS z_l_quantity,
       round((l_quantity - lq) / (hq - lq), 6) AS mm_l_quantity, round((l_extendedprice - mp) / sp, 6) AS z_l_extendedprice,
       round((l_extendedprice - lp) / (hp - lp), 6) AS mm_l_extendedprice FROM lineitem, s""")
def scale_columns(spark, d):
    s = ml.scale_columns(T(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], keep=["l_orderkey", "l_linenumber"])
    return s.select(*[F.round(c, 6).alias(c) if c.startswith(("z_", "mm_")) else F.col(c) for c in s.columns])


@query("encode_segment", """
WITH f AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1),
r AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY n DESC, c_mktsegment) - 1 AS DOUBLE) AS segment_index FROM f)
SELECT c_custkey, c_mktsegment, segment_index FROM customer JOIN r USING (c_mktsegment)""")
def encode_segment(spark, d):
    c = T(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return ml.string_index(c, "c_mktsegment", "segment_index")


@query("pca")
def pca(spark, d):
    return ml.pca(T(spark, d, "embeddings"), "embedding", 2, keep=["vec_id"])


@query("kmeans")
def kmeans(spark, d):
    return ml.kmeans(T(spark, d, "embeddings"), "embedding", 4, keep=["vec_id", "label"])
