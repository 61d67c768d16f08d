"""Stored rollups that merge: moments and a histogram of relative error per interval, added up for longer intervals.

A dashboard reads the stored rows instead of the events. Every row counts the values of one bucket, whose bounds grow by
``(1 + error) / (1 - error)``, so counts of a longer interval are sums and a percentile is known within ``error`` of the
value (Masson, Rim, Lee, DDSketch, 2019). All steps are sums that combine on the map side; the rows of an interval are at
most the buckets its values fall in, however many values there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import interval_window

ERROR = 0.01
_MOMENTS = ("n", "total", "squares", "least", "most")


def _growth(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    return math.log((1 + error) / (1 - error))


def _bucket(value: Column, error: float) -> Column:
    """``(side, place)``: the sign of a value and the number of its bucket of magnitudes; descending for negative ones."""
    place = F.ceil(F.ln(F.nullif(F.abs(value), F.lit(0.0))) / F.lit(_growth(error))).cast("int")
    side = F.signum(value).cast("int")
    return F.struct(side.alias("side"), F.coalesce(F.when(value < 0, -place).otherwise(place), F.lit(0)).alias("place"))


def representative(side: Column, place: Column, error: float = ERROR) -> Column:
    """The value that stands for a bucket: within ``error`` of each value in it, relative to that value."""
    magnitude = F.exp(F.when(side < 0, -place).otherwise(place) * F.lit(_growth(error))) * (1 - error)
    return F.when(side == 0, F.lit(0.0)).otherwise(side * magnitude)


def rollup(df: DataFrame, time_field: str, interval: str, value: str, group_by: Sequence[str] = (), error: float = ERROR) -> DataFrame:
    """``(*group_by, timestamp, side, place, n, total, squares, least, most)``, to be stored: a row per group, interval
    and bucket of ``value``. Rows without a time, and values that are null, NaN or infinite, are left out."""
    number = F.col(value).cast("double")
    rows = df.filter(F.col(time_field).isNotNull()).select(*group_by, interval_window(F.col(time_field), interval)["start"].alias("timestamp"), number.alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf"))).withColumn("_b", _bucket(F.col("_v"), error))
    sums = [F.count("*").alias("n"), F.sum("_v").alias("total"), F.sum(F.col("_v") * F.col("_v")).alias("squares"), F.min("_v").alias("least"), F.max("_v").alias("most")]
    return rows.groupBy(*group_by, "timestamp", F.col("_b.side").alias("side"), F.col("_b.place").alias("place")).agg(*sums)


def merged(stored: DataFrame, interval: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Stored rows of shorter intervals as those of a longer one, which they must divide; groups may become fewer.

    Stores of several runs or tables, made with one ``error``, are merged by their union."""
    at = interval_window(F.col("timestamp"), interval)["start"].alias("timestamp")
    sums = [F.sum(c).alias(c) for c in ("n", "total", "squares")] + [F.min("least").alias("least"), F.max("most").alias("most")]
    return stored.select(*group_by, at, "side", "place", *_MOMENTS).groupBy(*group_by, "timestamp", "side", "place").agg(*sums)


def summary(stored: DataFrame, percentiles: Sequence[float] = (0.5, 0.95), group_by: Sequence[str] = (), error: float = ERROR) -> DataFrame:
    """``(*group_by, timestamp, n, mean, stddev, least, most, p50 ...)`` of stored rows, one row per group and interval.

    Count, mean, extremes and sample deviation are those of the values; a percentile is the smallest value with that share
    of the values at or below it, within ``error``, and never outside the extremes."""
    key = [*group_by, "timestamp"]
    whole = Window.partitionBy(*key)
    running = stored.withColumn("_upto", F.sum("n").over(whole.orderBy("side", "place"))).withColumn("_all", F.sum("n").over(whole))
    near = representative(F.col("side"), F.col("place"), error)
    cuts = []
    for q in percentiles:
        at = F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.col("_all") * F.lit(float(q))))
        low = F.min(F.when(at, F.struct("_upto", near.alias("value"))))["value"]
        cuts.append(F.greatest(F.min("least"), F.least(F.max("most"), low)).alias(f"p{round(q * 100)}"))
    n, total, squares = F.sum("n"), F.sum("total"), F.sum("squares")
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), squares - total * total / n) / F.nullif(n - 1, F.lit(0))))
    moments = [n.alias("n"), (total / n).alias("mean"), spread.alias("stddev"), F.min("least").alias("least"), F.max("most").alias("most")]
    return running.groupBy(*key).agg(*moments, *cuts)
