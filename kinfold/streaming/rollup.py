"""The time-series rollup over an unbounded table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.analytics import aggregation, equality_filter, interval_window


def streaming_timeseries(df: DataFrame, time_field: str, interval: str, metric: str = "count", filters: Mapping[str, object] | None = None,
                         delay: str = "10 minutes") -> DataFrame:
    """``(timestamp, value)`` per interval; an interval is final, and leaves the state, once the watermark has passed it."""
    marked = equality_filter(df, filters).withWatermark(time_field, delay)
    return (
        marked.groupBy(interval_window(F.col(time_field), interval).alias("_w"))
        .agg(aggregation(metric).alias("value"))
        .select(F.col("_w.start").alias("timestamp"), "value")
    )
