"""tabulon: tabular analysis (profiling, quality, statistics, chart data,
exploration, extraction) expressed as lazy Spark DataFrame jobs."""

from tabulon.session import get_spark

__all__ = ["get_spark"]
