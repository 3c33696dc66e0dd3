"""Operators: DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One file of one site: what a whole-file test groups by.
FILE_KEY = ("prefix", "site", "time")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (it is counted up to there), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
