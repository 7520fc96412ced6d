"""Composed flows (F1–F3): one lineage per flow, the cleaned table shared.

``quick_analysis``: quality → clean → (statistics, chart recommendation →
chart data → chart list).  ``smart_analysis``: load → explore → report.
``load_correlation``: a CSV source → correlation of every numeric column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.columns import normalise_nan, numeric_columns
from tabulon.operators import chartdata as cd
from tabulon.operators import explore as ex
from tabulon.operators import quality as qa
from tabulon.operators import report as rp
from tabulon.operators import stats as st
from tabulon.session import local_frame, shared_folder, shared_table, small_frame
from tabulon.sources.files import load


@dataclass
class QuickAnalysis:
    report: DataFrame
    cleaned: DataFrame
    rows_removed: DataFrame
    describe: DataFrame
    correlation: DataFrame | None
    recommendations: DataFrame
    chart: DataFrame
    charts: DataFrame
    analysis: DataFrame


#: Analyses the quick flow offers.
ANALYSES = ("descriptive", "correlation", "t_test", "normality")


def quick_analysis(df: DataFrame, auto_clean: bool = True, approx: bool = False,
                   goal: str = "", analysis: str = "descriptive", dependent: str | None = None,
                   group: str | None = None) -> QuickAnalysis:
    """F1.  The cleaned table is written once as Parquet to the shared
    checkpoint folder, so the three branches reuse it instead of re-running
    the cleaning, and each reads only the columns it needs.

    ``analysis``: descriptive, correlation, t_test (of ``dependent`` by ``group``) or
    normality (of ``dependent``, else the first numeric column), as rows (item, value)."""
    if analysis not in ANALYSES:
        raise ValueError(f"Unknown analysis {analysis!r}; one of {ANALYSES}")
    if analysis == "t_test" and not (dependent and group):
        raise ValueError("T-test requires dependent and group variables")
    spark, source = df.sparkSession, df
    df = normalise_nan(df)
    # One quantile pass over the numeric columns gives the outlier fences
    # (report and clipping bounds) and the quartiles for describe; the column
    # counts of the report and the moments for describe and correlation ride
    # along in its counting pass.
    nums0 = numeric_columns(df)
    counts, outl, qs0, moments0 = qa.quality_pass(df, approx, st.DESCRIBE_PROBS, st.moment_aggs(nums0))
    report = small_frame(qa.quality_report(df, approx=approx, outliers=outl, counts=counts))
    if auto_clean:
        bounds = {r["column_name"]: (r["lower_bound"], r["upper_bound"]) for r in outl.collect()}
        nulls = [r["column_name"] for r in qa.missing_values(df, counts).collect()]
        if not nulls and not bounds and report.first()["n_duplicates"] == 0:
            # No nulls, no outliers, no copies: every cleaning step is a no-op,
            # so the table is already clean (no shuffle, no rewrite).
            cleaned = df
        else:
            cleaned = shared_table(qa.clean(df, approx=approx, bounds=bounds, null_columns=nulls), "cleaned")
    else:
        cleaned = df
    n_rows = report.first()["n_rows"]
    removed = (local_frame(spark, [(n_rows, n_rows, 0)], "rows_before long, rows_after long, rows_removed long")
               if cleaned is df else small_frame(qa.rows_removed(df, cleaned)))
    nums = numeric_columns(cleaned)
    if cleaned is df and nums:
        describe = st.describe_from(spark, nums, qs0, moments0)
    else:
        describe = small_frame(st.describe(cleaned, nums, approx=approx))
    corr = None
    if analysis == "correlation":
        corr = small_frame(st.correlation(cleaned, nums, first=moments0 if cleaned is df else None))
    found = _analysis_rows(cleaned, analysis, describe, corr, dependent, group)
    recs = small_frame(cd.spec_title(cd.chart_checks(cd.recommend_charts(cleaned, goal, approx=approx))))
    top = recs.orderBy("priority").limit(1).collect()
    if top:
        r = top[0]
        chart = cd.chart_data(cleaned, r["chart_type"], r["x_field"], r["y_field"], r["color_field"],
                              r["size_field"])
        charts = cd.one_chart_list(spark, f"{r['chart_type']}:{r['x_field']}:{r['y_field']}",
                                   r["chart_type"], r["title"])
    else:
        chart = spark.createDataFrame([], "x string")
        charts = spark.createDataFrame([], cd.CHART_SCHEMA)
    # Where cleaning changed nothing, the caller's own table comes back.
    cleaned = source if cleaned is df else cleaned
    return QuickAnalysis(report, cleaned, removed, describe, corr, recs, chart, charts, found)


def _analysis_rows(df, analysis, describe, corr, dependent, group) -> DataFrame:
    """The chosen analysis as rows (item, value)."""
    if analysis == "descriptive":
        # Means at four decimals: the sixth decimal of a mean that sits on a
        # rounding tie flips with the order the partitions are summed in (seen
        # on lineitem's l_discount, whose exact mean is 0.0499185).
        return describe.select(F.concat_ws(".", "column_name", F.lit("mean")).alias("item"),
                               F.round("mean", 4).cast("string").alias("value"))
    if analysis == "correlation":
        return corr.filter(F.col("i") < F.col("j")).select(
            F.concat_ws("~", "var1", "var2").alias("item"), _four(F.col("r")).alias("value"))
    if analysis == "t_test":
        one = st.with_t_pvalue(st.t_test(df, dependent, group))
        fields = ("t_statistic", "df", "cohens_d", "p_value")
    else:
        one = st.shapiro_wilk(df, dependent)
        fields = ("sample_size", "statistic", "p_value")
    return small_frame(one).select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("item"), _four(F.col(f)).alias("value")) for f in fields])))


def _four(x):
    """Four decimals as text, without a negative zero; null stays null."""
    return F.when(x.isNotNull(), F.format_string("%.4f", F.round(x.cast("double"), 4) + F.lit(0.0)))


def quick_analysis_summary(df: DataFrame, approx: bool = False, analysis: str = "descriptive",
                           dependent: str | None = None, group: str | None = None) -> DataFrame:
    """F1 as one long frame (section, item, value) for a stable contract."""
    qa_ = quick_analysis(df, approx=approx, analysis=analysis, dependent=dependent, group=group)
    def kv(k, v):
        return F.struct(F.lit(k).alias("item"), v.cast("string").alias("value"))

    rep = qa_.report.select(F.lit("quality").alias("section"), F.inline(F.array(
        kv("quality_score", F.round("quality_score", 4)), kv("band", F.col("band")),
        kv("n_rows", F.col("n_rows")), kv("n_duplicates", F.col("n_duplicates")),
        kv("n_missing_cols", F.col("n_missing_cols")), kv("n_outlier_cols", F.col("n_outlier_cols")))))
    rem = qa_.rows_removed.select(F.lit("cleaning").alias("section"), F.lit("rows_removed").alias("item"),
                                  F.col("rows_removed").cast("string").alias("value"))
    desc = qa_.analysis.select(F.lit("describe" if analysis == "descriptive" else analysis).alias("section"),
                               "item", "value")
    recs = qa_.recommendations.select(F.lit("chart").alias("section"),
                                      F.concat(F.lit("priority_"), F.col("priority").cast("string")).alias("item"),
                                      F.concat_ws(":", "chart_type", "x_field", "y_field").alias("value"))
    return rep.unionByName(rem).unionByName(desc).unionByName(recs)


def smart_analysis(spark: SparkSession, df: DataFrame, plan: list[dict], goal: str,
                   max_iterations: int = 3) -> tuple[ex.Exploration, DataFrame]:
    """explore, then a report with the step charts filled in."""
    e = ex.explore(spark, df, plan, max_iterations)
    steps = e.step_log(spark)
    charts = ex.steps_chart_list(steps)
    return e, rp.fill_placeholders(rp.report_markdown(charts, goal), charts)


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A folder under the cluster's shared checkpoint location (never a
    machine-local temp folder)."""
    return shared_folder(spark, name)


def load_correlation(spark: SparkSession, source_type: str, path: str,
                     variables: list[str] | None = None) -> DataFrame:
    """load a source, correlate all numeric columns (or the given ones)."""
    df = load(spark, source_type, path)
    cols = variables or numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("Correlation analysis requires at least 2 numeric variables")
    return st.correlation(df, cols)
