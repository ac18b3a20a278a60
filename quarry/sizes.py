"""Checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast of a table that a count has shown to be small; larger ones are shuffled."""
    return F.broadcast(df) if df.count() <= rows else df
