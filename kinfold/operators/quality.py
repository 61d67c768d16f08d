"""Validation, quarantine and outlier flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .analytics import percentile_columns
from .mapping import PROPERTY_TYPES

FLAGS = ("_valid_id", "_valid_name", "_valid_email")


def with_validity(df: DataFrame) -> DataFrame:
    """Add the three flags and ``_is_valid``; a null value is invalid, so each row is on exactly one side."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    df = df.withColumns(
        {
            "_valid_id": sure(F.length(F.col("id").cast("string")) > 0),
            "_valid_name": sure(F.length("name") > 0),
            "_valid_email": sure(F.contains(F.col("email"), F.lit("@"))),
        }
    )
    return df.withColumn("_is_valid", reduce(lambda a, b: a & b, [F.col(c) for c in FLAGS]))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the flags, invalid rows with them)."""
    flagged = with_validity(df)
    return flagged.filter("_is_valid").drop(*FLAGS, "_is_valid"), flagged.filter("NOT _is_valid")


def recombine(*parts: DataFrame) -> DataFrame:
    """Union of frames by column name; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def check_properties(df: DataFrame, schema: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Check rows against property definitions ``{name: {type, required, enum}}``.

    Adds ``errors`` (``property:reason`` in definition order) and ``status`` PASSED or QUARANTINED.
    """
    checks: list[Column] = []
    for name, rule in schema.items():
        value = F.col(name) if name in df.columns else F.lit(None).cast("string")
        text = value.cast("string")
        present = value.isNotNull() & (text != "")
        if rule.get("required"):
            checks.append(F.when(~present, F.lit(f"{name}:required")))
        kind = PROPERTY_TYPES[str(rule.get("type", "string"))]
        if kind != "string":
            checks.append(F.when(present & text.try_cast(kind).isNull(), F.lit(f"{name}:type")))
        if rule.get("enum"):
            checks.append(F.when(present & ~text.isin(*rule["enum"]), F.lit(f"{name}:enum")))
    df = df.withColumn("errors", F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))
    return df.withColumn("status", F.when(F.size("errors") == 0, F.lit("PASSED")).otherwise(F.lit("QUARANTINED")))


def flag_outliers(df: DataFrame, column: str, group: Sequence[str] = (), method: str = "zscore", limit: float | None = None) -> DataFrame:
    """Add ``is_outlier``: |z| above 3, or outside 1.5 interquartile ranges, within each group.

    The group's figures are aggregated on the map side and joined back. Unlike a window, this never brings the rows of
    a group that holds a third of the table together in one task.
    """
    x = F.col(column)
    if method == "zscore":
        figures = df.groupBy(*group).agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_sd"))
        flag = F.abs(x - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)) > (limit or 3.0)
    elif method == "iqr":
        figures = percentile_columns(df, column, {"_q1": 0.25, "_q3": 0.75}, group)
        reach = (F.col("_q3") - F.col("_q1")) * (limit or 1.5)
        flag = (x < F.col("_q1") - reach) | (x > F.col("_q3") + reach)
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    names = [c for c in figures.columns if c not in group]
    figures = materialize(figures) if group else figures  # of known size: few groups are broadcast and the rows stay where they are
    stated = df.join(figures, list(group), "left") if group else df.withColumns({c: figures.select(c).scalar() for c in names})
    return stated.withColumn("is_outlier", F.coalesce(flag, F.lit(False))).drop(*names)
