"""Exploration and report queries (X1–X9) over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import explore as ex
from tabulon.operators import report as rp
from tabulon.plans.registry import query
from tabulon.sources.tables import read_table as T

GOAL = "Find the year with the highest order total"
PLAN = [
    {"explanation": "Total order value per month",
     "sql_query": "SELECT date_format(o_orderdate, 'yyyy-MM') AS month, sum(o_totalprice) AS total "
                  "FROM data GROUP BY 1 ORDER BY 1"},
    {"explanation": "Roll the monthly totals up to years",
     "sql_query": "SELECT substr(month, 1, 4) AS year, sum(total) AS total FROM data GROUP BY 1 ORDER BY 1"},
    {"explanation": "Pick the best year",
     "sql_query": "SELECT year, total FROM data ORDER BY total DESC, year LIMIT 1"},
]


def run_plan(spark, d):
    return ex.explore(spark, T(spark, d, "orders"), PLAN, max_iterations=3)


def plan_steps(spark, d):
    """The step log (a driver-side frame); the cached step results are
    released once it is built."""
    e = run_plan(spark, d)
    steps = e.step_log(spark)
    e.release()
    return steps


@query("explore_chain", """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1),
y AS (SELECT substr(month, 1, 4) AS year, sum(total) AS total FROM m GROUP BY 1)
SELECT year, round(total, 2) AS total FROM y ORDER BY total DESC, year LIMIT 1""")
def explore_chain(spark, d):
    res = run_plan(spark, d).result
    return res.select("year", F.round("total", 2).alias("total"))


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _finding(n, cols, share):
    """The X5 finding text, spelled in DuckDB (values at two decimals)."""
    head = ", ".join(f"{c} = ' || {v} || '" for c, v in cols)
    tail = (f" || CASE WHEN {n} > 1 AND s <> 0 THEN printf(' That row holds %.1f%% of all {share}.', v / s * 100) "
            "ELSE '' END") if share else ""
    return f"'The result has ' || {n} || ' rows and 2 columns. First row: {head}.'{tail}"


# The three steps of PLAN, computed independently in DuckDB.
_STEPS_SQL = f"""
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1),
y AS (SELECT substr(month, 1, 4) AS year, sum(total) AS total FROM m GROUP BY 1),
b AS (SELECT year, total FROM y ORDER BY total DESC, year LIMIT 1),
f1 AS (SELECT (SELECT count(*) FROM m) AS n, month AS k, total AS v, (SELECT sum(total) FROM m) AS s
       FROM m ORDER BY month LIMIT 1),
f2 AS (SELECT (SELECT count(*) FROM y) AS n, year AS k, total AS v, (SELECT sum(total) FROM y) AS s
       FROM y ORDER BY year LIMIT 1),
f3 AS (SELECT (SELECT count(*) FROM b) AS n, year AS k, total AS v, CAST(NULL AS DOUBLE) AS s FROM b),
steps AS (
  SELECT CAST(1 AS INTEGER) AS step_number, {_lit(PLAN[0]["explanation"])} AS transformation,
         {_lit(PLAN[0]["sql_query"])} AS sql_query,
         {_finding("n", [("month", "k"), ("total", "printf('%.2f', v)")], "total")} AS insight,
         'bar' AS chart_type, 'ok' AS status, CAST(n AS BIGINT) AS n_rows, CAST(2 AS INTEGER) AS n_cols FROM f1
  UNION ALL
  SELECT CAST(2 AS INTEGER), {_lit(PLAN[1]["explanation"])}, {_lit(PLAN[1]["sql_query"])},
         {_finding("n", [("year", "k"), ("total", "printf('%.2f', v)")], "total")},
         'bar', 'ok', CAST(n AS BIGINT), CAST(2 AS INTEGER) FROM f2
  UNION ALL
  SELECT CAST(3 AS INTEGER), {_lit(PLAN[2]["explanation"])}, {_lit(PLAN[2]["sql_query"])},
         {_finding("n", [("year", "k"), ("total", "printf('%.2f', v)")], None)},
         'bar', 'ok', CAST(n AS BIGINT), CAST(2 AS INTEGER) FROM f3)"""

_CHARTS_SQL = _STEPS_SQL + """,
charts AS (SELECT step_number AS idx, 'Step ' || step_number || ': ' || substr(transformation, 1, 50) || '...' AS title,
                  'step-' || step_number || '-' || chart_type AS image, insight AS description
           FROM steps WHERE chart_type <> 'none')"""


@query("step_log", _STEPS_SQL + " SELECT * FROM steps")
def step_log(spark, d):
    """One row per executed step."""
    return plan_steps(spark, d)


@query("step_findings", _STEPS_SQL + " SELECT step_number, insight FROM steps")
def step_findings(spark, d):
    """The rule-based finding of each step."""
    return plan_steps(spark, d).select("step_number", "insight")


@query("exploration_report", _STEPS_SQL + f"""
SELECT '# Data Exploration Report' || E'\n\n' || '## Goal' || E'\n' || {_lit(GOAL)} || E'\n\n' || '## Findings'
       || E'\n\n' || string_agg('**Step ' || step_number || '**: ' || transformation || E'\n' || '- Finding: '
                                  || insight, E'\n\n' ORDER BY step_number)
       || E'\n\n' || '## Conclusion' || E'\n' || 'Completed ' || count(*) || ' exploration steps.' || E'\n' AS report
FROM steps""")
def exploration_report(spark, d):
    """Fallback markdown from the step log."""
    return ex.fallback_report(plan_steps(spark, d), GOAL)


# X8 + X9: one section per chart, its placeholder already replaced by the image line.
_CHART_REPORT_SQL = _CHARTS_SQL + f"""
SELECT '# Analysis Report' || E'\n\n' || '## Goal' || E'\n' || {_lit(GOAL)} || E'\n\n' || '## Charts' || E'\n\n'
       || string_agg('### Chart ' || idx || ': ' || title || ' - ' || description || E'\n\n' || E'\n' || '![' || title
                     || '](' || image || ')' || E'\n' || E'\n', E'\n' ORDER BY idx) AS report
FROM charts"""


@query("chart_report", _CHART_REPORT_SQL)
def chart_report(spark, d):
    """X6 + X8 + X9: chart list from the steps, report body, placeholders filled."""
    steps = plan_steps(spark, d)
    charts = ex.steps_chart_list(steps)
    return rp.fill_placeholders(rp.report_markdown(charts, GOAL), charts)


@query("report_sink", "SELECT report || E'\\n' AS markdown FROM (" + _CHART_REPORT_SQL + ")")
def report_sink(spark, d):
    """The exploration report written as one markdown file under the
    shared scratch folder, read back as text."""
    from tabulon.plans.flows import shared_scratch, smart_analysis
    from tabulon.sources.sinks import write_report
    e, report = smart_analysis(spark, T(spark, d, "orders"), PLAN, GOAL)
    e.release()                      # the report is built from the driver-side step log
    path = write_report(report, shared_scratch(spark, "report"))
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "markdown")
