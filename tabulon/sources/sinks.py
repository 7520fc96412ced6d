"""Sinks: tables to files, report text to one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Distributed write: one file per task, optional hive-style partitions."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_report(report: DataFrame, path: str, column: str = "report") -> str:
    """Markdown report (a one-row frame) to a text file.  The report is small
    by construction, so a single output file is wanted here."""
    report.select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path
