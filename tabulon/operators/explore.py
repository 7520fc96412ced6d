"""Multi-step exploration: each step's SQL runs on the previous result.

The chain is a sequence of lazy plans; each step result is registered as the
view ``data`` for the next step.  Every few steps the current result is
checkpointed to the shared checkpoint folder so long chains keep a short
lineage (and survive lost executors).  Only bounded step metadata — counts,
the first row, the chart type — reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import is_numeric, q
from tabulon.operators.chartdata import auto_chart
from tabulon.operators.relational import run_query
from tabulon.session import local_frame, reliable_checkpoint

STEP_SCHEMA = T.StructType([
    T.StructField("step_number", T.IntegerType()), T.StructField("transformation", T.StringType()),
    T.StructField("sql_query", T.StringType()), T.StructField("insight", T.StringType()),
    T.StructField("chart_type", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("n_rows", T.LongType()), T.StructField("n_cols", T.IntegerType())])


@dataclass
class Exploration:
    result: DataFrame
    steps: list[dict] = field(default_factory=list)
    charts: dict[int, DataFrame] = field(default_factory=dict)
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Drop the cached step results once the caller is done with them."""
        for df in self.cached:
            df.unpersist()
        self.cached.clear()

    def step_log(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(s[f.name] for f in STEP_SCHEMA.fields) for s in self.steps]
        return local_frame(spark, rows, STEP_SCHEMA)


def step_shape(df: DataFrame) -> tuple[int, object]:
    """Row count and the total of the last numeric column, in one job."""
    nums = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    total = F.sum(q(nums[-1])) if nums else F.lit(None)
    row = df.agg(F.count(F.lit(1)).alias("n"), total.alias("total")).first()
    return row["n"], row["total"]


def step_finding(df: DataFrame, n: int | None = None, total=None) -> str:
    """A one-to-two sentence finding from the result's shape and first row:
    the row count, the first row and, for the last numeric column, that
    row's share of the column total (``n`` and ``total`` from
    :func:`step_shape` when the caller has them)."""
    cols = df.columns
    nums = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    ordered = not df._jdf.queryExecution().analyzed().outputOrdering().isEmpty()
    sortable = [q(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    # A result without an order of its own is read in the order of its columns.
    first = (df if ordered or not sortable else df.orderBy(*sortable)).limit(1).collect()
    if n is None:
        n, total = step_shape(df)
    if not first:
        return f"The query returned no rows ({len(cols)} columns)."
    head = ", ".join(f"{c} = {_show(first[0][c])}" for c in cols)
    text = f"The result has {n} rows and {len(cols)} columns. First row: {head}."
    if nums and n > 1:
        c = nums[-1]
        if total:
            share = float(first[0][c] or 0) / float(total) * 100
            text += f" That row holds {share:.1f}% of all {c}."
    return text


def _show(v) -> str:
    """A value as finding text.  Fractional numbers get two decimals: the last
    digits of a floating-point sum depend on the order the partitions were
    added in, and a finding must not change with the partitioning."""
    import datetime
    import decimal
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.2f}"
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(v)


def explore(spark: SparkSession, df: DataFrame, plan: list[dict], max_iterations: int = 3,
            checkpoint_every: int = 5) -> Exploration:
    """Run up to ``max_iterations`` planned steps.

    A step is ``{"sql_query", "explanation", "action"}``; ``action ==
    "conclude"`` stops, a blank query skips, a failing query is logged as a
    step and the table stays as it was."""
    if df.isEmpty():
        raise ValueError("Input table has no data rows")
    ex = Exploration(result=df)
    current = df
    for step_num in range(1, max_iterations + 1):
        if step_num > len(plan):
            break
        step = plan[step_num - 1]
        if step.get("action") == "conclude":
            break
        sql = (step.get("sql_query") or "").strip()
        if not sql:
            continue
        explanation = step.get("explanation", "")
        try:
            out = run_query(spark, {"data": current}, sql)
            if len(ex.steps) % checkpoint_every == checkpoint_every - 1:
                out = reliable_checkpoint(out)
            else:
                # Several small actions read the step result: compute it once.
                out = out.persist(StorageLevel.MEMORY_AND_DISK)
                ex.cached.append(out)
            n_rows, total = step_shape(out)      # forces evaluation: runtime errors surface here
            insight = step_finding(out, n_rows, total)
            chart_type, chart = auto_chart(out)
        except Exception as e:  # noqa: BLE001 — fail soft, as specified
            ex.steps.append(dict(step_number=step_num, transformation=explanation, sql_query=sql,
                                 insight=f"Query failed: {e}", chart_type="none",
                                 status="failed", n_rows=None, n_cols=None))
            continue
        ex.steps.append(dict(step_number=step_num, transformation=explanation, sql_query=sql, insight=insight,
                             chart_type=chart_type, status="ok", n_rows=n_rows, n_cols=len(out.columns)))
        ex.charts[step_num] = chart
        current = out
    ex.result = current
    return ex


def steps_chart_list(steps: DataFrame) -> DataFrame:
    """Charts of the steps that have one; title ``Step n: <50 chars>...``."""
    return steps.filter(F.col("chart_type") != "none").select(
        F.col("step_number").alias("idx"),
        F.concat(F.lit("Step "), F.col("step_number").cast("string"), F.lit(": "),
                 F.substring(F.coalesce("transformation", F.lit("")), 1, 50), F.lit("...")).alias("title"),
        F.concat(F.lit("step-"), F.col("step_number").cast("string"), F.lit("-"), F.col("chart_type")).alias("image"),
        F.col("insight").alias("description"))


def fallback_report(steps: DataFrame, goal: str) -> DataFrame:
    """Goal, findings per step in order, conclusion."""
    # The report's headings and line format.
    item = F.format_string("**Step %d**: %s\n- Finding: %s", F.col("step_number"),
                           F.coalesce("transformation", F.lit("")), F.coalesce("insight", F.lit("")))
    agg = steps.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_number", item.alias("t")))),
                                             lambda s: s["t"]), "\n\n").alias("findings"),
                    F.count(F.lit(1)).alias("n"))
    return agg.select(F.when(F.col("n") == 0, F.concat(F.lit("# Exploration Report\n\nGoal: "), F.lit(goal),
                                                        F.lit("\n\nNo exploration steps were completed.")))
                      .otherwise(F.format_string("# Data Exploration Report\n\n## Goal\n%s\n\n## Findings\n\n%s\n\n"
                                                 "## Conclusion\nCompleted %d exploration steps.\n",
                                                 F.lit(goal), F.col("findings"), F.col("n"))).alias("report"))
