"""Column types from text samples, in one job for all columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip

# The Spark type each inferred type is read as.
INFERRED_TYPES = {"INTEGER": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "STRING": "string"}

_SECONDS = r"([01]\d|2[0-3]):[0-5]\d:[0-5]\d"
_DAY = r"(0[1-9]|[12]\d|3[01])"
_MONTH = r"(0[1-9]|1[0-2])"
_ISO_DATE = rf"\d{{4}}-{_MONTH}-{_DAY}"
_ISO_CLOCK = r"T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?"
_ZONE = r"(Z|[+-]\d{2}:\d{2}(:\d{2})?)(\[[A-Za-z_/+\-0-9]+\])?"


def _is_long(v: Column) -> Column:
    return v.rlike(r"^[+-]?\d+$") & v.try_cast("bigint").isNotNull()


def _is_double(v: Column) -> Column:
    return v.rlike(r"^[+-]?(NaN|Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?)$")


def _is_timestamp(v: Column) -> Column:
    """ISO date, ISO date-time with or without zone (real calendar days only), or one of the four plain layouts."""
    iso = v.rlike(rf"^{_ISO_DATE}({_ISO_CLOCK}({_ZONE})?)?$") & F.substring(v, 1, 10).try_cast("date").isNotNull()
    plain = (
        rf"^{_ISO_DATE} {_SECONDS}(\.\d{{3}})?$",
        rf"^{_MONTH}/{_DAY}/\d{{4}} {_SECONDS}$",
        rf"^{_DAY}-{_MONTH}-\d{{4}} {_SECONDS}$",
    )
    return iso | v.rlike("|".join(plain))


def _is_ui_timestamp(v: Column) -> Column:
    shape = (F.length(v) >= 8) & v.rlike("[-/]")
    date = rf"(\d{{4}}[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01])|(0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01])[-/]\d{{4}})"
    clock = r"([T ]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?"
    return shape & v.rlike(rf"^{date}{clock}$")


def _verdict(tests: Sequence[tuple[str, Column]], seen: Column) -> Column:
    out = F.when(seen == 0, F.lit("STRING"))
    for name, passed in tests:
        out = out.when(passed, F.lit(name))
    return out.otherwise(F.lit("STRING"))


def infer_schema(df: DataFrame, columns: Sequence[str] | None = None, profile: str = "backend",
                 order_by: str | Sequence[str] | None = None, sample: int = 100) -> DataFrame:
    """``(column, type)`` per text column.

    ``backend``: the first ``sample`` non-blank values by ``order_by``; INTEGER, DOUBLE, BOOLEAN, TIMESTAMP, STRING in
    that order. The sample is a top-k per column, cut down in every task before the shuffle. ``ui``: all non-blank
    values; BOOLEAN first, and a double must contain a point.
    """
    columns = list(columns or [c for c, t in df.dtypes if t == "string"])
    order = [order_by] if isinstance(order_by, str) else list(order_by or [])
    long = df.unpivot(
        [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], [F.col(c) for c in columns], "column", "value"
    ).filter(~is_blank(F.col("value")))
    v = strip(F.col("value"))
    boolean = F.lower(v).isin("true", "false", "1", "0")
    if profile == "backend":
        rank = F.row_number().over(Window.partitionBy("column").orderBy(*([f"_o{i}" for i in range(len(order))] or [F.lit(0)])))
        long = long.withColumn("_r", rank).filter(F.col("_r") <= sample)
        tests = [("INTEGER", _is_long(v)), ("DOUBLE", _is_double(v)), ("BOOLEAN", boolean), ("TIMESTAMP", _is_timestamp(v))]
    elif profile == "ui":
        double = _is_double(v) & F.contains(v, F.lit("."))
        tests = [("BOOLEAN", boolean), ("INTEGER", v.rlike(r"^-?\d+$")), ("DOUBLE", double), ("TIMESTAMP", _is_ui_timestamp(v))]
    else:
        raise ValueError(f"unknown profile {profile!r}")
    checked = long.groupBy("column").agg(
        F.count("*").alias("_seen"), *[F.bool_and(F.coalesce(c, F.lit(False))).alias(f"_{name}") for name, c in tests]
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(checked, "column", "left").select(
        "column", _verdict([(name, F.col(f"_{name}")) for name, _ in tests], F.coalesce("_seen", F.lit(0))).alias("type")
    )


def cast_inferred(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Read text columns as their inferred types; unreadable values become null."""
    return df.withColumns({c: strip(F.col(c)).try_cast(INFERRED_TYPES[t]) for c, t in types.items() if t != "STRING"})
