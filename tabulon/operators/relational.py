"""SQL transform surface and relational building blocks.

``sql_transform`` runs caller SQL through Catalyst over any number of views;
the helpers below are the same constructs as DataFrame calls, each shaped so
the heavy work (joins, grouping) stays partitioned and pre-aggregated.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.operators.ranking import running_sum


def check_read_only(spark: SparkSession, query: str) -> str:
    """R2: exactly one query, decided by Spark's own parser.

    The text must parse on its own and as a subquery; a subquery cannot write, set
    or define anything, nor hold a second statement."""
    body = query.strip().rstrip(";").strip()
    if not body:
        raise ValueError("SQL query is empty")
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        parser.parsePlan(body)
        parser.parsePlan(f"SELECT * FROM (\n{body}\n)")
    except Exception as e:
        raise ValueError(f"Only one read-only SELECT query is allowed: {str(e).splitlines()[0]}") from e
    return body


#: A query that starts with WITH, whatever comments stand before.
_WITH = re.compile(r"(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)*with\b", re.I | re.S)


def run_query(spark: SparkSession, tables: dict[str, DataFrame], query: str) -> DataFrame:
    """One read-only query over named frames.

    The frames are bound to their names inside the query itself (common table
    expressions over views of unique names, dropped once the query is analysed), so no view
    of the caller is read, replaced or dropped, the catalog is not listed, and runs of
    several threads don't meet.  A view of the caller under one of the names is hidden."""
    body = check_read_only(spark, query)
    views = {name: f"tabulon_{uuid.uuid4().hex}" for name in tables}
    made = []
    try:
        for name, df in tables.items():
            df.createTempView(views[name])
            made.append(views[name])
        bound = ", ".join(f"`{name.replace('`', '``')}` AS (SELECT * FROM {view})" for name, view in views.items())
        if not bound:
            return spark.sql(body)
        # A query's own WITH goes into a subquery, where its names come first.
        return spark.sql(f"WITH {bound} SELECT * FROM (\n{body}\n)" if _WITH.match(body) else f"WITH {bound}\n{body}")
    finally:
        for view in made:
            spark.catalog.dropTempView(view)


def sql_transform(spark: SparkSession, tables: dict[str, DataFrame] | DataFrame, query: str,
                  require_rows: bool = False) -> DataFrame:
    """Run one read-only query over the inputs under their names (:func:`run_query`).

    A single DataFrame is bound to ``input_data`` (the reference name) and ``data``."""
    if isinstance(tables, DataFrame):
        tables = {"input_data": tables, "data": tables}
    out = run_query(spark, tables, query)
    if require_rows and out.isEmpty():
        raise ValueError("Query returned no results")
    return out


def running_total(df: DataFrame, order_col: str, value_col: str, partition_cols=(), name="running_total"):
    """Cumulative sum in order, per partition columns or over the whole table (then
    from range partitions and their offsets, not in one task)."""
    if not partition_cols:
        return running_sum(df, [order_col], F.col(value_col), name)
    w = Window.partitionBy(*partition_cols).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value_col).over(w))


def rolling_mean(df: DataFrame, order_col: str, value_col: str, rows: int, partition_cols=(), name="rolling_avg"):
    """Mean of the current and ``rows-1`` preceding rows."""
    w = Window.partitionBy(*partition_cols).orderBy(order_col).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.avg(value_col).over(w))


def share_of_total(df: DataFrame, value_col: str, partition_cols=(), name="share_pct"):
    """Percent of the (partition) total; input is already aggregated.  The grand
    total is one aggregated row, not a window over all rows."""
    if not partition_cols:
        total = df.agg(F.sum(value_col).alias("_total"))
        return df.withColumn(name, F.col(value_col) / total.scalar() * 100)
    w = Window.partitionBy(*partition_cols)
    return df.withColumn(name, F.col(value_col) / F.sum(value_col).over(w) * 100)


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, rank_col="rn"):
    """First ``k`` rows per group.  The filter on ``row_number`` lets
    Spark insert a partial per-task top-k before the shuffle, so a hot group
    never ships more than ``k`` rows per task."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def period_over_period(agg: DataFrame, keys: list[str], period_col: str, value_col: str,
                       lag_periods: int = 1, prev_name="prev_value"):
    """Join each period to the same key ``lag_periods`` earlier (both
    sides are already aggregated, one row per key and period)."""
    prev = agg.select(*keys, (F.col(period_col) + lag_periods).alias(period_col),
                      F.col(value_col).alias(prev_name))
    return agg.join(prev, [*keys, period_col], "left")


def trend_slope(agg: DataFrame, key_cols, x_col: str, y_col: str, name="slope"):
    """Least-squares slope of y over x per key (``regr_slope``)."""
    return agg.groupBy(*key_cols).agg(F.regr_slope(y_col, x_col).alias(name),
                                      F.count(F.lit(1)).alias("n_points"))


def segment_vs_overall(df: DataFrame, segment_col: str, value_col: str, count_col: str | None = None):
    """Per-segment mean against the overall mean.  The overall figure is
    rebuilt from the per-segment sums, so no second scan and no cross join.

    With ``count_col`` the input is already partially aggregated: each row
    holds a sum (``value_col``) and the number of values behind it."""
    n = F.sum(count_col) if count_col else F.count(value_col)
    seg = df.groupBy(segment_col).agg(F.sum(value_col).alias("_s"), n.alias("_c"))
    overall = seg.agg((F.sum("_s") / F.sum("_c")).alias("overall")).scalar()
    return seg.select(segment_col, (F.col("_s") / F.col("_c")).alias("segment_avg"),
                      overall.alias("overall_avg")).withColumn(
        "diff", F.col("segment_avg") - F.col("overall_avg"))


def list_agg(df: DataFrame, key_cols, value_col: str, distinct=True, sep=","):
    """Sorted list of values per key, as text.  Distinct values combine
    map-side, so the per-key list is bounded by the value domain."""
    src = df.select(*key_cols, value_col)
    if distinct:
        src = src.distinct()
    return src.groupBy(*key_cols).agg(
        F.array_join(F.array_sort(F.collect_list(value_col)).cast("array<string>"), sep).alias("values"))


def pivot_sum(df: DataFrame, row_col: str, pivot_col: str, values: list, value_col: str):
    """Sum per row key, one output column per listed pivot value."""
    return df.groupBy(row_col).pivot(pivot_col, values).agg(F.sum(value_col))
