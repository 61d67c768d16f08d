"""Joins of a wide table with a narrow one whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def narrow(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a settled frame of a few numbers a row for broadcast if it has at most ``rows`` rows.

    Beyond that Spark shuffles both sides; the result is the same. Counting stops at the bound.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
