"""Profiling queries (P1–P11, S10) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import profile as pr
from tabulon.plans.registry import query
from tabulon.sources.tables import TABLE_NAMES, read_table as T

# (name, spark dtype, semantic class) of the profiled tables, for the oracle text.
CUSTOMER = [("c_custkey", "bigint", "quantitative"), ("c_name", "string", "nominal"),
            ("c_nationkey", "int", "quantitative"), ("c_acctbal", "double", "quantitative"),
            ("c_mktsegment", "string", "nominal")]
PART = [("p_partkey", "bigint", "quantitative"), ("p_name", "string", "nominal"),
        ("p_brand", "string", "nominal"), ("p_type", "string", "nominal"),
        ("p_size", "int", "quantitative"), ("p_retailprice", "double", "quantitative")]
ORDERS = [("o_orderkey", "bigint", "quantitative"), ("o_custkey", "bigint", "quantitative"),
          ("o_orderstatus", "string", "nominal"), ("o_totalprice", "double", "quantitative"),
          ("o_orderdate", "timestamp_ntz", "temporal"), ("o_orderpriority", "string", "nominal")]


def _samples_sql(table, c, k):
    return (f"(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v "
            f"FROM {table} WHERE {c} IS NOT NULL ORDER BY v LIMIT {k}))")


def profile_sql(table, cols):
    parts = []
    for i, (c, dt, sem) in enumerate(cols):
        num = sem == "quantitative"
        stat = (lambda f: f"round(CAST({f}({c}) AS DOUBLE), 6)") if num else (lambda f: "CAST(NULL AS DOUBLE)")
        samples = _samples_sql(table, c, 3) if sem == "nominal" else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS position, '{dt}' AS dtype, "
            f"'{sem}' AS semantic_type, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
            f"count(*) > count({c}) AS nullable, count(DISTINCT {c}) AS n_unique, "
            f"{stat('min')} AS min_value, {stat('max')} AS max_value, {stat('avg')} AS mean_value, "
            f"{samples} AS samples FROM {table}")
    return "\nUNION ALL ".join(parts)


def _round_stats(df, cols=("min_value", "max_value", "mean_value")):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("profile", profile_sql("customer", CUSTOMER))
def profile_q(spark, d):
    return _round_stats(pr.profile(T(spark, d, "customer")))


@query("profile_numeric", profile_sql("part", PART))
def profile_numeric(spark, d):
    return _round_stats(pr.profile(T(spark, d, "part")))


@query("profile_orders", profile_sql("orders", ORDERS))
def profile_orders(spark, d):
    return _round_stats(pr.profile(T(spark, d, "orders")))


@query("profile_temporal", """
SELECT 'o_orderdate' AS column_name, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min_value,
       strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_value FROM orders
UNION ALL
SELECT 'l_shipdate', strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S'), strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S')
FROM lineitem""")
def profile_temporal(spark, d):
    return pr.temporal_stats(T(spark, d, "orders")).unionByName(pr.temporal_stats(T(spark, d, "lineitem")))


@query("samples", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, {_samples_sql('part', c, 3)} AS samples"
    for c, _, s in PART if s == "nominal"))
def samples(spark, d):
    p = T(spark, d, "part")
    return pr.smallest_values(p, [c for c, _, s in PART if s == "nominal"], 3)


def _unique_sql(table, cols):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, "
            f"string_agg(DISTINCT CAST({c} AS VARCHAR), ', ' ORDER BY CAST({c} AS VARCHAR)) AS unique_values "
            f"FROM {table} HAVING count(DISTINCT {c}) <= 10")
    return "\nUNION ALL ".join(parts)


@query("unique_values", _unique_sql("orders", ["o_orderstatus", "o_orderpriority"]) + "\nUNION ALL "
       + _unique_sql("customer", ["c_name", "c_mktsegment"]))
def unique_values(spark, d):
    o, c = T(spark, d, "orders"), T(spark, d, "customer")
    return (pr.unique_values(o, ["o_orderstatus", "o_orderpriority"], 10)
            .unionByName(pr.unique_values(c, ["c_name", "c_mktsegment"], 10)))


def _field_types_sql(table, cols):
    parts = []
    for i, (c, dt, sem) in enumerate(cols):
        if sem == "quantitative":
            ft = (f"CASE WHEN count(DISTINCT {c}) < 20 AND count(DISTINCT {c}) < count(*) * 0.5 "
                  f"THEN 'ordinal' ELSE 'quantitative' END")
        else:
            ft = f"'{sem}'"
        parts.append(f"SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS position, {ft} AS field_type, "
                     f"count(DISTINCT {c}) AS n_unique, count(*) AS n_rows FROM {table}")
    return "\nUNION ALL ".join(parts)


@query("field_types", _field_types_sql("part", PART))
def field_types(spark, d):
    return pr.field_types(T(spark, d, "part"))


def _field_stats_sql(table, cols, round_mean=True):
    parts = []
    for i, (c, dt, sem) in enumerate(cols):
        num = sem == "quantitative"

        def st(f, c=c, num=num):
            if not num:
                return "CAST(NULL AS DOUBLE)"
            return f"CAST({f}({c}) AS DOUBLE)" if (f == "avg" and not round_mean) else f"round(CAST({f}({c}) AS DOUBLE), 6)"
        uv = (f"CASE WHEN count(DISTINCT {c}) <= 10 THEN string_agg(DISTINCT CAST({c} AS VARCHAR), ', ' "
              f"ORDER BY CAST({c} AS VARCHAR)) END") if sem == "nominal" else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS position, '{sem}' AS semantic_type, "
                     f"count(DISTINCT {c}) AS unique_count, {st('min')} AS stat_min, {st('max')} AS stat_max, "
                     f"{st('avg')} AS stat_mean, {uv} AS unique_values FROM {table}")
    return "\nUNION ALL ".join(parts)


@query("field_stats", _field_stats_sql("orders", ORDERS))
def field_stats(spark, d):
    fs = pr.field_stats(T(spark, d, "orders"))
    return fs.select(*[F.round(c, 6).alias(c) if c.startswith("stat_") else F.col(c) for c in fs.columns])


@query("field_stats_given", "WITH s AS (" + _field_stats_sql("orders", ORDERS) + """)
SELECT column_name, position, CASE WHEN column_name = 'o_custkey' THEN 'ordinal' ELSE semantic_type END AS semantic_type,
       CASE WHEN column_name = 'o_custkey' THEN (SELECT count(*) FROM customer) ELSE unique_count END AS unique_count,
       stat_min, CASE WHEN column_name = 'o_custkey' THEN (SELECT max(c_custkey) FROM customer)::DOUBLE ELSE stat_max END AS stat_max,
       stat_mean, unique_values FROM s""")
def field_stats_given(spark, d):
    """P7 with a schema that knows o_custkey from the customer table."""
    given = T(spark, d, "customer").agg(F.count(F.lit(1)).alias("unique_count"), F.max("c_custkey").alias("hi")).select(
        F.lit("o_custkey").alias("column_name"), F.lit("ordinal").alias("semantic_type"), "unique_count",
        F.lit(None).cast("double").alias("stat_min"), F.col("hi").cast("double").alias("stat_max"),
        F.lit(None).cast("double").alias("stat_mean"))
    fs = pr.field_stats(T(spark, d, "orders"), given)
    return fs.select(*[F.round(c, 6).alias(c) if c.startswith("stat_") else F.col(c) for c in fs.columns])


@query("field_lines", """
WITH s AS (""" + _field_stats_sql("orders", ORDERS, round_mean=False) + """)
SELECT column_name, position,
  concat_ws(' ', '- **' || column_name || '**', '(' || semantic_type || ')',
            '[' || CAST(unique_count AS VARCHAR) || ' unique values]',
            CASE WHEN stat_min IS NOT NULL THEN 'Range: ' || CAST(stat_min AS VARCHAR) || ' to ' || CAST(stat_max AS VARCHAR) END,
            CASE WHEN stat_mean IS NOT NULL THEN printf('Mean: %.2f', stat_mean) END,
            CASE WHEN unique_values IS NULL THEN NULL
                 WHEN len(string_split(unique_values, ', ')) <= 5 THEN 'Values: ' || unique_values
                 ELSE 'Sample values: ' || array_to_string(string_split(unique_values, ', ')[1:5], ', ') || ', ...' END) AS line
FROM s""")
def field_lines(spark, d):
    fs = pr.field_stats(T(spark, d, "orders"), as_list=True)
    fs = fs.select(*[F.round(c, 6).alias(c) if c in ("stat_min", "stat_max") else F.col(c) for c in fs.columns])
    return pr.field_lines(fs)


@query("preview", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
       o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10""")
def preview(spark, d):
    o = T(spark, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return pr.preview(o, 10, ["o_orderkey"])


_NCOLS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
          "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3,
          "conversations": 4}


@query("shape", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST({_NCOLS[t]} AS INTEGER) AS n_cols FROM {t}"
    for t in TABLE_NAMES))
def shape(spark, d):
    out = None
    for t in TABLE_NAMES:
        s = pr.shape(T(spark, d, t), t)
        out = s if out is None else out.unionByName(s)
    return out


@query("table_summary", """
SELECT column_name, dtype, n_unique, n_null FROM (
""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{dt}' AS dtype, count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_null "
    f"FROM lineitem" for c, dt in [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                                   ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                                   ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                                   ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]) + ")")
def table_summary(spark, d):
    """Dtype, distinct and null counts per column of one table."""
    st = pr.column_stats(T(spark, d, "lineitem"))
    return st.select("column_name", "dtype", "n_unique", "n_null")


def _summary_tail(c, sem):
    if sem == "quantitative":
        two = lambda f: f"printf('%.2f', {f}({c})::DOUBLE)"
        return f"', range ' || {two('min')} || ' to ' || {two('max')} || ', mean ' || {two('avg')}"
    if sem == "temporal":
        when = lambda f: f"strftime({f}({c}), '%Y-%m-%d %H:%M:%S')"
        return f"', from ' || {when('min')} || ' to ' || {when('max')}"
    return f"', e.g. ' || {_samples_sql('orders', c, 3)}"


@query("schema_summary", "SELECT 0 AS line_no, 'Table shape: ' || CAST(count(*) AS VARCHAR) || ' rows x 6 columns' AS line FROM orders\nUNION ALL "
       + "\nUNION ALL ".join(
           f"SELECT {i + 1} AS line_no, '  - {c} ({dt}): ' || CAST(count(DISTINCT {c}) AS VARCHAR) || ' unique values, ' "
           f"|| CAST(count(*) - count({c}) AS VARCHAR) || ' nulls' || {_summary_tail(c, sem)} AS line FROM orders"
           for i, (c, dt, sem) in enumerate(ORDERS))
       + f"\nUNION ALL SELECT {len(ORDERS) + 1}, 'Sample rows:'\nUNION ALL SELECT {len(ORDERS) + 1} + r, line FROM ("
       + "SELECT row_number() OVER (ORDER BY o_orderkey)::INTEGER AS r, '  ' || concat_ws(', ', "
       + ", ".join(f"'{c} = ' || {c}::VARCHAR" for c, _, _ in ORDERS) + ") AS line FROM orders) WHERE r <= 3")
def schema_summary(spark, d):
    """Shape, one line per column (type, counts, range or first values), sample rows."""
    return pr.schema_summary(T(spark, d, "orders"), sample_rows=3, order_by=["o_orderkey"])
