"""Anomalies of time series against a trailing baseline of the same hour or weekday."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import aggregation

_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
# They make both measures of spread equal the standard deviation of normal data.
MEDIAN_SCALE, MEAN_SCALE = 1.4826, 1.253314


def _seconds(interval: str) -> int:
    found = re.fullmatch(r"([1-9]\d*)([smhdw])", interval)
    if not found:
        raise ValueError(f"cannot read interval {interval!r}")
    return int(found[1]) * _SECONDS[found[2]]


def _median(values: Column) -> Column:
    """Median of a short array, the mean of the middle two if it is even; null if it is empty."""
    ordered = F.array_sort(values)
    n = F.size(values)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2.0
    return F.when(n > 0, middle)


def series_points(df: DataFrame, time_field: str, interval: str, metric: str, series: Sequence[str] = (), absent: float | None = None) -> DataFrame:
    """``(*series, at, value)``: the metric of each series per interval, ``at`` in seconds since the epoch, in UTC.

    Intervals without rows have no point; with ``absent`` they have that value, from the first to the last point of their
    series. Rows without a time are left out, and so are points whose metric is null.
    """
    step = _seconds(interval)
    second = F.unix_seconds(F.col(time_field).cast("timestamp"))
    at = (second - F.pmod(second, F.lit(step))).alias("at")
    points = df.filter(F.col(time_field).isNotNull()).groupBy(*series, at).agg(aggregation(metric).cast("double").alias("value")).filter("value IS NOT NULL")
    if absent is None:
        return points
    ends = points.groupBy(*series).agg(F.min("at").alias("_from"), F.max("at").alias("_to"))
    grid = ends.select(*series, F.explode(F.sequence("_from", "_to", F.lit(step).cast("long"))).alias("at"), F.lit(float(absent)).alias("value"))
    return points.withColumn("_own", F.lit(1)).unionByName(grid.withColumn("_own", F.lit(0))).groupBy(*series, "at").agg(F.max_by("value", "_own").alias("value"))


def anomalies(df: DataFrame, time_field: str, interval: str = "1h", metric: str = "count", series: Sequence[str] = (), season: str = "1d",
              history: int = 28, limit: float = 3.5, least: int = 5, absent: float | None = None) -> DataFrame:
    """``(*series, timestamp, value, n_before, expected, deviation, is_anomaly)``, a row for each point of ``series_points``.

    A point is compared with the points at the same place of the ``history`` seasons before it: the same hour of a day with
    ``season='1d'``, the same hour of the same weekday with ``season='1w'``. ``expected`` is their median, ``deviation`` the
    distance from it in scaled median deviations (scaled mean deviations if more than half of the points are equal, null if
    all are). A point is an anomaly beyond ``limit`` deviations, or at any distance where all points before are equal. With
    fewer than ``least`` points before it no point is judged. Later points never count, so a verdict does not change.

    The rows become one number per series and interval in an aggregate that combines on the map side; what a window
    holds for a point is at most ``history`` numbers, however many rows a series has.
    """
    step, span = _seconds(interval), _seconds(season)
    if span % step:
        raise ValueError("a season must be a whole number of intervals")
    points = series_points(df, time_field, interval, metric, series, absent)
    points = points.withColumns({"_season": F.floor(F.col("at") / span), "_place": F.pmod("at", F.lit(span))})
    before = Window.partitionBy(*series, "_place").orderBy("_season").rangeBetween(-history, -1)
    points = points.withColumn("_seen", F.collect_list("value").over(before)).withColumn("expected", _median(F.col("_seen")))
    points = points.withColumn("_off", F.transform("_seen", lambda x: F.abs(x - F.col("expected"))))
    mean = F.aggregate("_off", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_off"), F.lit(0))
    points = points.withColumns({"_mad": _median(F.col("_off")) * MEDIAN_SCALE, "_mean": mean * MEAN_SCALE, "n_before": F.size("_seen")})
    spread = F.coalesce(F.nullif("_mad", F.lit(0.0)), F.nullif("_mean", F.lit(0.0)))
    away = F.abs(F.col("value") - F.col("expected"))
    points = points.withColumn("deviation", away / spread)
    far = F.coalesce(F.col("deviation") > limit, away > 0, F.lit(False))
    return points.select(*series, F.timestamp_seconds("at").alias("timestamp"), "value", "n_before", "expected", "deviation", (far & (F.col("n_before") >= least)).alias("is_anomaly"))
