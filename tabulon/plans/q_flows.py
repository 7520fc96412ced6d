"""Flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.plans import flows
from tabulon.plans.q_explore import _CHART_REPORT_SQL, GOAL, PLAN
from tabulon.plans.derived import DIRTY_CTE, dirty_events
from tabulon.plans.q_stats import shapiro_ctes, t_test_ctes
from tabulon.plans.registry import query
from tabulon.sources.sinks import write_table
from tabulon.sources.tables import read_table as T

_LC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# lineitem's columns as (name, type, semantic class) for the F1 oracle.
LINEITEM = [("l_orderkey", "bigint", "quantitative"), ("l_partkey", "bigint", "quantitative"),
            ("l_suppkey", "bigint", "quantitative"), ("l_linenumber", "int", "quantitative"),
            ("l_quantity", "double", "quantitative"), ("l_extendedprice", "double", "quantitative"),
            ("l_discount", "double", "quantitative"), ("l_tax", "double", "quantitative"),
            ("l_returnflag", "string", "nominal"), ("l_linestatus", "string", "nominal"),
            ("l_shipdate", "timestamp", "temporal")]


def _quick_analysis_sql(table: str, cols, with_ctes: str = "", found: str | None = None) -> str:
    """F1 in DuckDB: quality on the raw table, the cleaning chain, means of the
    cleaned numeric columns (or ``found``, rows section, item, value over ``cleaned``)
    and the chart choice on the cleaned table."""
    from tabulon.plans.q_charts import recommend_ctes
    names = [c for c, _, _ in cols]
    nums = [c for c, _, sem in cols if sem == "quantitative"]
    union = "\nUNION ALL ".join
    need = -(-len(names) // 2)
    miss = union(f"SELECT '{c}' AS column_name, (count(*) - count({c})) * 100.0 / count(*) AS pct FROM src"
                 for c in names)
    fences = union(f"SELECT '{c}' AS column_name, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi "
                   f"FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM src)"
                   for c in nums)
    hits = union(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS k "
                 f"FROM src, fen WHERE fen.column_name = '{c}'" for c in nums)
    filled = []
    for c, _, sem in cols:
        if sem == "quantitative":
            filled.append(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM kept)) AS {c}")
        else:
            filled.append(f"coalesce({c}, (SELECT {c} FROM kept WHERE {c} IS NOT NULL GROUP BY {c} "
                          f"ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)) AS {c}")
    clipped = []
    for c in names:
        if c in nums:
            f = f"(SELECT {{}} FROM hits JOIN fen USING (column_name) WHERE column_name = '{c}' AND k > 0)"
            lo, hi = f.format("lo"), f.format("hi")
            clipped.append(f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END AS {c}")
        else:
            clipped.append(c)
    nonnull = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in names)
    means = union(f"SELECT 'describe' AS section, '{c}.mean' AS item, CAST(round(avg({c}), 4) AS VARCHAR) AS value, "
                  f"CAST({i} AS INTEGER) AS o FROM cleaned" for i, c in enumerate(nums))
    return f"""
WITH {with_ctes}src AS (SELECT * FROM {table}),
nn AS (SELECT count(*) AS n FROM src),
miss AS (SELECT * FROM ({miss}) WHERE pct > 0),
fen AS ({fences}),
hits AS ({hits}),
outl AS (SELECT h.column_name, h.k * 100.0 / (SELECT n FROM nn) AS pct FROM hits h WHERE h.k > 0),
dup AS (SELECT (SELECT n FROM nn) - (SELECT count(*) FROM (SELECT DISTINCT * FROM src)) AS d),
score AS (SELECT greatest(0.0, 100.0
                 - least(30.0, coalesce((SELECT avg(pct) FROM miss), 0.0) * 0.5)
                 - least(20.0, coalesce((SELECT avg(pct) FROM outl), 0.0) * 0.3)
                 - CASE WHEN d > 0 THEN least(20.0, d * 100.0 / (SELECT n FROM nn) * 0.5) ELSE 0.0 END) AS s, d
          FROM dup),
kept AS (SELECT * FROM src WHERE {nonnull} >= {need}),
filled AS (SELECT {", ".join(filled)} FROM kept),
cleaned AS (SELECT DISTINCT {", ".join(clipped)} FROM filled),
{recommend_ctes("", "cleaned", cols)}
SELECT section, item, value FROM (
  SELECT 'quality' AS section, 'quality_score' AS item, CAST(round(s, 4) AS VARCHAR) AS value FROM score
  UNION ALL SELECT 'quality', 'band', CASE WHEN s >= 80 THEN 'green' WHEN s >= 60 THEN 'yellow' ELSE 'red' END FROM score
  UNION ALL SELECT 'quality', 'n_rows', CAST(n AS VARCHAR) FROM nn
  UNION ALL SELECT 'quality', 'n_duplicates', CAST(d AS VARCHAR) FROM score
  UNION ALL SELECT 'quality', 'n_missing_cols', CAST(count(*) AS VARCHAR) FROM miss
  UNION ALL SELECT 'quality', 'n_outlier_cols', CAST(count(*) AS VARCHAR) FROM outl
  UNION ALL SELECT 'cleaning', 'rows_removed', CAST((SELECT n FROM nn) - count(*) AS VARCHAR) FROM cleaned
  UNION ALL SELECT section, item, value FROM ({found or means})
  UNION ALL SELECT 'chart', 'priority_' || priority, chart_type || ':' || x_field || ':' || y_field FROM titled)"""


@query("quick_analysis", _quick_analysis_sql("lineitem", LINEITEM))
def quick_analysis(spark, d):
    """F1 on lineitem: quality, cleaning, statistics, chart choice."""
    return flows.quick_analysis_summary(T(spark, d, "lineitem"))


def _correlation_rows(cols) -> str:
    nums = [c for c, _, sem in cols if sem == "quantitative"]
    return "\nUNION ALL ".join(
        f"SELECT 'correlation' AS section, '{a}~{b}' AS item, printf('%.4f', round(corr({a}, {b}), 4) + 0.0) AS value FROM cleaned"
        for i, a in enumerate(nums) for b in nums[i + 1:])


@query("quick_analysis_correlation", _quick_analysis_sql("lineitem", LINEITEM, found=_correlation_rows(LINEITEM)))
def quick_analysis_correlation(spark, d):
    return flows.quick_analysis_summary(T(spark, d, "lineitem"), analysis="correlation")


@query("quick_analysis_t_test", _quick_analysis_sql("lineitem", LINEITEM, found=f"""
  SELECT 't_test' AS section, item, printf('%.4f', round(x, 4) + 0.0) AS value FROM (
    {t_test_ctes("cleaned", "l_extendedprice", "l_linestatus")}
    SELECT unnest(['t_statistic', 'df', 'cohens_d', 'p_value']) AS item,
           unnest([t, df, d, p]) AS x FROM tt)"""))
def quick_analysis_t_test(spark, d):
    return flows.quick_analysis_summary(T(spark, d, "lineitem"), analysis="t_test", dependent="l_extendedprice",
                                        group="l_linestatus")


@query("quick_analysis_normality", _quick_analysis_sql("lineitem", LINEITEM, found=f"""
  SELECT 'normality' AS section, item, printf('%.4f', round(x, 4) + 0.0) AS value FROM (
    {shapiro_ctes("cleaned", "l_quantity")}
    SELECT unnest(['sample_size', 'statistic', 'p_value']) AS item,
           unnest([n::DOUBLE, w, NULL::DOUBLE]) AS x FROM sw)"""))
def quick_analysis_normality(spark, d):
    return flows.quick_analysis_summary(T(spark, d, "lineitem"), analysis="normality", dependent="l_quantity")


_DIRTY = [("event_id", "bigint", "quantitative"), ("user_id", "bigint", "quantitative"),
          ("event_type", "string", "nominal"), ("value", "double", "quantitative"), ("ts", "timestamp", "temporal")]


@query("quick_analysis_dirty", _quick_analysis_sql(
    "dirty", _DIRTY, DIRTY_CTE.strip().removeprefix("WITH").strip() + ",\n"))
def quick_analysis_dirty(spark, d):
    """F1 on the ``dirty`` events: every branch of the cleaning runs (sparse
    rows dropped, medians and modes filled, outliers clipped, copies removed)."""
    return flows.quick_analysis_summary(dirty_events(spark, d))


@query("smart_analysis", _CHART_REPORT_SQL)
def smart_analysis(spark, d):
    """F2 on orders: three exploration steps and the report."""
    e, report = flows.smart_analysis(spark, T(spark, d, "orders"), PLAN, GOAL)
    e.release()                      # the report is built from the driver-side step log
    return report


@query("load_correlation", "WITH c AS (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, corr({a}, {b}) AS r FROM lineitem"
    for i, a in enumerate(_LC) for j, b in enumerate(_LC)) + ") SELECT var1, var2, i, j, round(r, 6) AS r FROM c")
def load_correlation(spark, d):
    """lineitem's numeric columns written as CSV to the shared scratch
    folder, read back with inferred types, correlated."""
    path = flows.shared_scratch(spark, "csv")
    write_table(T(spark, d, "lineitem").select(*_LC), path, fmt="csv")
    c = flows.load_correlation(spark, "csv", path)
    return c.select("var1", "var2", "i", "j", F.round("r", 6).alias("r"))


@query("load_csv", """
SELECT CAST(c_custkey AS INTEGER) AS id,
       CASE WHEN c_custkey % 3 = 0 THEN 'a, "' || c_name || '"' || chr(10) || 'end' ELSE c_name END AS name,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer""")
def load_csv(spark, d):
    """Customers written with quoted commas, doubled quotes, line breaks and NA, half of them
    in files with another column order, and loaded."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('a, "'), "c_name", F.lit('"\nend'))).otherwise(F.col("c_name"))
    src = T(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), name.alias("name"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("NA")).otherwise(F.col("c_acctbal").cast("string")).alias("balance"))
    path = flows.shared_scratch(spark, "csv")
    even = F.col("id") % 2 == 0
    for part in (src.filter(even), src.filter(~even).select("balance", "name", "id")):
        part.write.mode("append").option("header", True).option("escape", '"').csv(path)
    return flows.load(spark, "csv", path).select("id", "name", "balance")


@query("load_csv_rejects", """
SELECT CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey AS INTEGER) END AS id,
       CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN c_name END AS name,
       CASE WHEN c_custkey % 7 = 0 THEN c_custkey || ',' || c_name || ',"x, y"' END AS rejected FROM customer""")
def load_csv_rejects(spark, d):
    """Records with a field too many go to a reject column, short ones are filled with nulls."""
    line = (F.when(F.col("c_custkey") % 7 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit(","), "c_name", F.lit(',"x, y"')))
            .when(F.col("c_custkey") % 5 == 0, F.col("c_custkey").cast("string"))
            .otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(","), "c_name")))
    path = flows.shared_scratch(spark, "csv")
    # Whole lines, without quotes of their own.
    (T(spark, d, "customer").select(line.alias("id,name")).write.option("header", True).option("sep", "\u0001")
     .option("quote", "").csv(path))
    return flows.load(spark, "csv", path, reject_column="rejected")


@query("load_json", "SELECT event_id, event_type, value, props FROM events")
def load_json(spark, d):
    """Events written as JSON-lines and loaded."""
    path = flows.shared_scratch(spark, "json")
    T(spark, d, "events").select("event_id", "event_type", "value", "props").write.json(path)
    return flows.load(spark, "json", path)
