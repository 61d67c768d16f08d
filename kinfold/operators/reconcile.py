"""Comparison of stores and of ontology versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _content(columns: Sequence[str]) -> Column:
    """Hash of a row's content in which a null and its place count."""
    return F.xxhash64(*[c for name in columns for c in (F.col(name), F.col(name).isNull())])


def _hashed(df: DataFrame, name: str, id_col: str, columns: Sequence[str], scope: Sequence[str], buckets: int) -> DataFrame:
    ids = F.col(id_col).cast("string")
    bucket = F.pmod(F.xxhash64(*scope, ids), F.lit(buckets)).cast("int")
    return df.select(*scope, ids.alias("id"), _content(columns).alias(f"hash_{name}"), bucket.alias("_bucket"))


def _unequal(sides: Mapping[str, DataFrame], scope: Sequence[str]) -> DataFrame:
    """Buckets of ids whose rows are not the same in all stores: by number and by the sum of their hashes, in which
    repeated rows do not cancel. One aggregate a store, combined on the map side."""
    sums = [
        side.groupBy("_bucket").agg(F.count("*").alias("_rows"), F.sum(F.xxhash64(*scope, "id", f"hash_{name}").cast("decimal(38,0)")).alias("_sum"))
        for name, side in sides.items()
    ]
    state = F.struct("_rows", "_sum")
    seen = reduce(lambda a, b: a.unionByName(b), sums).groupBy("_bucket").agg(F.count("*").alias("_stores"), F.min(state).alias("_least"), F.max(state).alias("_most"))
    return seen.filter((F.col("_stores") < len(sides)) | (F.col("_least") != F.col("_most"))).select("_bucket")


def compare_stores(stores: Mapping[str, DataFrame], columns: Sequence[str], id_col: str = "id", scope: Sequence[str] = ("tenant_id",), buckets: int = 1 << 16) -> DataFrame:
    """One row per tenant and id that is missing somewhere or whose content differs: ``missing_in`` (names) and ``differs``.

    Ids fall into ``buckets`` by their hash. Each store first tells number and checksum of every bucket, and only rows of
    buckets in which the stores disagree are joined: where they agree nothing is shuffled but the sums. More rows call
    for more buckets. Null columns are content like any other; rows with a null id match no other row.
    """
    sides = {name: _hashed(df, name, id_col, columns, scope, buckets) for name, df in stores.items()}
    drifted = materialize(_unequal(sides, scope))
    # at most ``buckets`` numbers
    open_ = [side.join(F.broadcast(drifted), "_bucket", "left_semi").drop("_bucket") for side in sides.values()]
    joined = reduce(lambda a, b: a.join(b, [*scope, "id"], "full"), open_)
    hashes = [F.col(f"hash_{name}") for name in stores]
    missing = F.array_compact(F.array(*[F.when(F.col(f"hash_{n}").isNull(), F.lit(n)) for n in stores]))
    lowest, highest = F.least(*hashes), F.greatest(*hashes)
    return joined.select(*scope, "id", missing.alias("missing_in"), (lowest != highest).alias("differs")).filter(
        (F.size("missing_in") > 0) | F.col("differs")
    )


def reconciliation_report(stores: Mapping[str, DataFrame], columns: Sequence[str], id_col: str = "id", scope: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """One row: status, rows and checksum per store, ids missing somewhere and ids that differ.

    The ids themselves are the rows of ``compare_stores``; the report holds their numbers, whatever their size.
    """
    drift = compare_stores(stores, columns, id_col, scope).agg(
        F.count_if(F.size("missing_in") > 0).alias("missing_ids"), F.count_if("differs").alias("different_ids")
    )
    for name, df in stores.items():
        drift = drift.withColumns(
            {
                f"{name}_count": df.agg(F.count("*")).scalar(),
                f"{name}_checksum": df.agg(F.coalesce(F.sum(_content(columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).scalar(),
            }
        )
    clean = (F.col("missing_ids") == 0) & (F.col("different_ids") == 0)
    return drift.withColumn("status", F.when(clean, F.lit("HEALTHY")).otherwise(F.lit("DRIFT_DETECTED")))


def ontology_diff(old: DataFrame, new: DataFrame, key: str = "type_name", definition: str = "definition") -> DataFrame:
    """``(type, change)`` with change ADDED, MODIFIED or REMOVED; unchanged types are left out."""
    a = old.select(F.col(key).alias("type_name"), F.col(definition).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(F.col(key).alias("type_name"), F.col(definition).alias("_new"), F.lit(True).alias("_is"))
    change = (
        F.when(F.col("_was").isNull(), F.lit("ADDED"))
        .when(F.col("_is").isNull(), F.lit("REMOVED"))
        .when(~F.col("_old").eqNullSafe(F.col("_new")), F.lit("MODIFIED"))
    )
    return a.join(b, "type_name", "full").select("type_name", change.alias("change")).filter(F.col("change").isNotNull())
