"""Ad-hoc aggregation, distributions and time-series rollups."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .paging import numbered

_FUNCTIONS = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max,
    "stddev": F.stddev_samp, "std": F.stddev_samp, "count_distinct": F.count_distinct,
}
_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def equality_filter(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """AND of ``column = value``; a list means any of its values, None means null."""
    for name, value in (filters or {}).items():
        wanted = F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name).eqNullSafe(F.lit(value))
        df = df.filter(wanted)
    return df


def tenant_scope(df: DataFrame, tenant_id: str, tenant: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; on tables partitioned by tenant this prunes partitions."""
    return df.filter(F.col(tenant) == tenant_id)


def aggregation(text: str) -> Column:
    """``fn`` or ``fn:column`` as an aggregate named ``fn`` or ``fn_column``."""
    fn, _, column = text.partition(":")
    if fn not in _FUNCTIONS:
        raise ValueError(f"unknown aggregation {fn!r}")
    if not column and fn != "count":
        raise ValueError(f"aggregation {fn!r} needs a column")
    return _FUNCTIONS[fn](F.col(column) if column else F.lit(1)).alias(f"{fn}_{column}" if column else fn)


def _scope(df: DataFrame, tenant_id: str | None, entity_type: str | None, filters: Mapping[str, object] | None) -> DataFrame:
    scope = {k: v for k, v in (("tenant_id", tenant_id), ("entity_type", entity_type)) if v is not None}
    return equality_filter(df, {**scope, **(filters or {})})


def query(df: DataFrame, aggregations: Sequence[str] = (), filters: Mapping[str, object] | None = None, tenant_id: str | None = None,
          entity_type: str | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """Aggregates over the rows of a tenant and entity type that pass the filters, and ``row_count``."""
    scoped = _scope(df, tenant_id, entity_type, filters)
    return scoped.groupBy(*group_by).agg(*[aggregation(a) for a in aggregations], F.count(F.lit(1)).alias("row_count"))


def interval_window(time: Column, interval: str) -> Column:
    """Window of an interval text (``15m``, ``1h``, ``1d``, ``1w``); weeks start on Monday."""
    found = re.fullmatch(r"(\d+)([smhdw])", interval)
    if not found:
        raise ValueError(f"cannot read interval {interval!r}")
    n, unit = int(found[1]), found[2]
    # the epoch was a Thursday: four days later is a Monday
    return F.window(time, f"{n} {_UNITS[unit]}", startTime="4 days" if unit == "w" else "0 seconds")


def timeseries(df: DataFrame, time_field: str, interval: str, metric: str = "count", filters: Mapping[str, object] | None = None,
               tenant_id: str | None = None, entity_type: str | None = None) -> DataFrame:
    """Ordered ``(timestamp, value)``: the metric (``fn`` or ``fn:column``) per interval that has rows."""
    scoped = _scope(df, tenant_id, entity_type, filters)
    return (
        scoped.groupBy(interval_window(F.col(time_field), interval).alias("_w"))
        .agg(aggregation(metric).alias("value"))
        .select(F.col("_w.start").alias("timestamp"), "value")
        .orderBy("timestamp")
    )


def exact_percentiles(df: DataFrame, column: str, percentiles: Sequence[float], group_by: Sequence[str] = ()) -> DataFrame:
    """``(*group_by, percentile, value)``: exact percentiles with linear interpolation, without holding a group in one task.

    Equal values are counted first. The distinct values are ranged over tasks, and running counts within and before each
    range say which value stands at a wanted rank.
    """
    group = list(group_by) or ["_all"]
    rows = df if group_by else df.withColumn("_all", F.lit(0))
    values = rows.filter(F.col(column).isNotNull()).groupBy(*group, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    running = materialize(numbered(values, group, ["_v"], "_c"))
    totals = running.groupBy(*group).agg(F.max("_number").alias("_total"))
    asked = totals.withColumn("percentile", F.explode(F.array(*[F.lit(float(q)) for q in percentiles]))).withColumn(
        "_at", F.col("percentile") * (F.col("_total") - 1)
    )
    ranks = asked.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    ranks = ranks.withColumnsRenamed({c: f"_g_{c}" for c in group})
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    reached = (F.col("_rank") < F.col("_number")) & (F.col("_rank") >= F.col("_number") - F.col("_c"))
    # the asked ranks are a few per group
    hit = running.join(ranks, same).filter(reached).select(*group, "percentile", "_at", "_v")
    low, high = F.min("_v"), F.max("_v")
    share = F.first("_at") - F.floor(F.first("_at"))
    found = hit.groupBy(*group, "percentile").agg((low + (high - low) * share).alias("value"))
    return found if group_by else found.drop("_all")


def percentile_columns(df: DataFrame, column: str, named: Mapping[str, float], group_by: Sequence[str] = ()) -> DataFrame:
    """One row per group with a column per named exact percentile."""
    long = exact_percentiles(df, column, sorted(set(named.values())), group_by)
    at = lambda q: F.max(F.when(F.col("percentile") == q, F.col("value")))
    return long.groupBy(*group_by).agg(*[at(float(q)).alias(name) for name, q in named.items()])


def statistics(df: DataFrame, column: str, percentiles: Sequence[float] = (0.25, 0.5, 0.75, 0.95), group_by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Count, mean, deviation, median and percentiles per group. ``exact=False`` takes the percentiles from one sketch."""
    plain = [F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("stddev")]
    named = {"median": 0.5, **{f"p{round(q * 100)}": float(q) for q in percentiles}}
    if not exact:
        return df.groupBy(*group_by).agg(*plain, *[F.percentile_approx(column, q).alias(name) for name, q in named.items()])
    moments, cuts = df.groupBy(*group_by).agg(*plain), percentile_columns(df, column, named, group_by)
    if group_by:
        return moments.join(cuts, list(group_by), "left")
    return moments.withColumns({name: cuts.select(name).scalar() for name in named})


def distribution(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per equal-width bin of [low, high); bin 0 is below, bin ``bins + 1`` at or above."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(
        F.count("*").alias("n")
    )


def facet_counts(df: DataFrame, facet: str = "entity_type") -> DataFrame:
    return df.groupBy(facet).agg(F.count("*").alias("n"))
