"""Report assembly: chart summaries, a markdown body and placeholder fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chart_summaries(charts: DataFrame) -> DataFrame:
    """``Chart i: title - description`` lines in chart order."""
    line = F.concat(F.lit("Chart "), F.col("idx").cast("string"), F.lit(": "), F.coalesce("title", F.lit("Untitled")),
                    F.when(F.coalesce(F.col("description"), F.lit("")) != "",
                           F.concat(F.lit(" - "), F.col("description"))).otherwise(F.lit("")))
    return charts.select("idx", line.alias("summary"))


def report_markdown(charts: DataFrame, goal: str) -> DataFrame:
    """A markdown report with one placeholder per chart (or the no-chart text)."""
    s = chart_summaries(charts)
    items = F.array_sort(F.collect_list(F.struct("idx", "summary")))
    agg = s.agg(items.alias("items"), F.count(F.lit(1)).alias("n"))
    body = F.array_join(F.transform("items", lambda it: F.format_string(
        "### %s\n\n{{chart_%d}}\n", it["summary"], it["idx"])), "\n")
    return agg.select(F.when(F.col("n") == 0, F.format_string(
        "# Analysis Report\n\n## Goal\n%s\n\nNo visualizations were generated for this analysis.\n", F.lit(goal)))
        .otherwise(F.format_string("# Analysis Report\n\n## Goal\n%s\n\n## Charts\n\n%s", F.lit(goal), body))
        .alias("report"))


def fill_placeholders(report: DataFrame, charts: DataFrame, column: str = "report") -> DataFrame:
    """``{{chart_i}}`` → image markdown, or the bold title when no image."""
    items = charts.agg(F.collect_list(F.struct("idx", "title", "image")).alias("cs")).select("cs").scalar()

    def step(acc, c):
        title = F.coalesce(c["title"], F.concat(F.lit("Chart "), c["idx"].cast("string")))
        ph = F.concat(F.lit("{{chart_"), c["idx"].cast("string"), F.lit("}}"))
        rep = F.when(F.coalesce(F.length(c["image"]), F.lit(0)) > 0,
                     F.concat(F.lit("\n!["), title, F.lit("]("), c["image"], F.lit(")\n"))) \
            .otherwise(F.concat(F.lit("\n**"), title, F.lit("**\n")))
        return F.replace(acc, ph, rep)

    empty = F.array().cast("array<struct<idx:int,title:string,image:string>>")
    # The chart list arrives as a scalar subquery in its own projection:
    # higher-order functions may not hold subqueries themselves.
    staged = report.select(F.col(column), F.coalesce(items, empty).alias("_charts"))
    return staged.select(F.aggregate(F.col("_charts"), F.col(column), step).alias(column))
