"""Preview, search and pages of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def preview(df: DataFrame, order_by: Sequence[str | Column] = (), rows: int = 100) -> DataFrame:
    """The first rows; with an order this is a top-k, taken in every task before anything is shuffled."""
    return (df.orderBy(*order_by) if order_by else df).limit(rows)


def preview_search(df: DataFrame, term: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which the text of any column contains the term, any case; a blank term keeps all."""
    if not term.strip():
        return df
    hit = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(term.lower())), F.lit(False)) for c in columns or df.columns]
    return df.filter(reduce(lambda a, b: a | b, hit))


def page(df: DataFrame, number: int, size: int = 10, order_by: Sequence[str | Column] = ("id",)) -> DataFrame:
    """Page ``number`` (from 0) of an ordered table; for deep pages see ``page_after``."""
    return df.orderBy(*order_by).offset(number * size).limit(size)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    """One row ``pages``, at least 1."""
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(size))).cast("bigint").alias("pages"))


def page_after(df: DataFrame, last: Mapping[str, object], order_by: Sequence[tuple[str, bool]] = (("id", True),), size: int = 10) -> DataFrame:
    """The page after the row with the values ``last``; ``order_by`` names columns and whether they ascend.

    Unlike an offset, whose rows all pass one task, this is a filter and a top-k of ``size`` rows in every task, however
    deep the page lies. Nulls come last either way; the columns together must tell rows apart.
    """
    beyond, same = F.lit(False), F.lit(True)
    for name, ascending in order_by:
        column, value = F.col(name), F.lit(last[name])
        if last[name] is None:
            here = F.lit(False)
        else:
            here = F.coalesce(column > value if ascending else column < value, F.lit(True))
        beyond = beyond | (same & here)
        same = same & column.eqNullSafe(value)
    order = [F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, up in order_by]
    return df.filter(beyond).orderBy(*order).limit(size)


def numbered(df: DataFrame, group: Sequence[str], order_by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Add ``_number``, the place of each row (from 1) in its group in the given order, or the running sum of ``weight``.

    The rows are ranged over tasks by group and order; each task numbers its own and adds what the counts of the ranges
    before it say. No task orders a whole group, and the numbers depend on the rows alone.
    """
    n = F.count("*") if weight is None else F.sum(weight)
    ranged = materialize(df.repartitionByRange(*group, *order_by).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*group, "_range").agg(n.alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    inside = Window.partitionBy(*group, "_range").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.count("*") if weight is None else F.sum(weight)
    same = [ranged[c].eqNullSafe(F.col(f"_g_{c}")) for c in group] + [ranged["_range"] == F.col("_g_range")]
    known = counts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_range").alias("_g_range"), "_before")
    placed = ranged.withColumn("_own", own.over(inside)).join(known, same)
    return placed.withColumn("_number", F.col("_before") + F.col("_own")).drop("_range", "_before", "_own", "_g_range", *[f"_g_{c}" for c in group])
