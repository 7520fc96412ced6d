"""Argument and emptiness guards shared by sources and operators."""

from __future__ import annotations

from pyspark.sql import DataFrame


class SourceError(ValueError):
    """Bad source type, missing argument or unreadable input."""


def require_rows(df: DataFrame, what: str = "Data table") -> DataFrame:
    """Raise if the frame has no rows (one short job that stops at the first row)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def require_columns(df: DataFrame, *cols: str | None) -> None:
    missing = [c for c in cols if c and c not in df.columns]
    if missing:
        raise ValueError(f"Field(s) not found in data: {missing}; available: {df.columns}")
