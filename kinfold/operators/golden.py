"""Survivorship: one golden record per cluster, and the record every value came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip

# Record columns that are bookkeeping, head columns of a golden record, and timestamp columns by rank.
BOOKKEEPING = ("id", "raw_id", "block_key", "decision", "confidence_score", "cluster_id")
HEAD = ("golden_id", "tenant_id", "cluster_size", "created_at")
TIMESTAMPS = ("updated_at", "joined_at", "staged_at")


def attribute_columns(df: DataFrame) -> list[str]:
    """Columns that survive into a golden record, by name."""
    return sorted(c for c in df.columns if c not in BOOKKEEPING and c not in HEAD and not c.startswith("score_"))


def golden_id(tenant: Column, cluster: Column) -> Column:
    """Stable id, so that a rerun names the same cluster the same way."""
    return F.concat(F.lit("gr-"), F.sha2(F.concat_ws(":", tenant, cluster), 256))


def smallest_last(text: Column) -> Column:
    """Sort key that is greatest for the smallest text: negated code points and an end mark."""
    return F.concat(F.transform(F.split(text, ""), lambda ch: -F.ascii(ch)), F.array(F.lit(1)))


def record_time(df: DataFrame) -> Column:
    """First non-empty of the timestamp columns as text, else empty; compared as text."""
    known = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in TIMESTAMPS if c in df.columns]
    return F.coalesce(*known, F.lit(""))


def golden_records(records: DataFrame, tenant: str = "tenant_id", id_col: str = "id", attributes: Sequence[str] | None = None,
                   created_at: Column | None = None) -> DataFrame:
    """One row per ``(tenant, cluster_id)`` with ``cluster_size`` and the surviving attributes.

    Per attribute the non-blank value of the latest record wins, then the longest text, then the smallest record id.
    All attributes come from one aggregate whose state per cluster is one value per attribute, combined on the map
    side. ``golden_members`` has the members of every cluster as rows, whatever its size.
    """
    attributes = list(attributes or attribute_columns(records))
    key = [tenant, "cluster_id"]
    ranked = records.withColumns({"_time": record_time(records), "_id": smallest_last(F.col(id_col).cast("string"))})

    def survivor(c: str) -> Column:
        order = F.struct(F.col("_time"), F.length(strip(F.col(c).cast("string"))), F.col("_id"))
        return F.max_by(F.col(c), F.when(~is_blank(F.col(c)), order)).alias(c)

    golden = ranked.groupBy(*key).agg(F.count("*").alias("cluster_size"), *[survivor(c) for c in attributes])
    made = created_at if created_at is not None else F.current_timestamp()
    return golden.select(
        golden_id(F.col(tenant), F.col("cluster_id")).alias("golden_id"), F.col(tenant).alias("tenant_id"), "cluster_id",
        "cluster_size", made.alias("created_at"), *attributes,
    )


def golden_members(records: DataFrame, tenant: str = "tenant_id", id_col: str = "id") -> DataFrame:
    """``(golden_id, tenant_id, source_record_id)``, one row per record."""
    return records.select(
        golden_id(F.col(tenant), F.col("cluster_id")).alias("golden_id"), F.col(tenant).alias("tenant_id"),
        F.col(id_col).cast("string").alias("source_record_id"),
    )


def field_provenance(golden: DataFrame, records: DataFrame, attributes: Sequence[str] | None = None, id_col: str = "id",
                     tenant: str = "tenant_id", created_at: Column | None = None) -> DataFrame:
    """One row per non-blank golden attribute: the first record (by id) of the cluster with the same text, else the first record.

    Records meet their golden row in one join and collapse again in one map-side combined aggregate; the attributes
    become rows only after that.
    """
    attributes = list(attributes or [c for c in attribute_columns(golden) if c in records.columns])
    key = [tenant, "cluster_id"]
    text = lambda c: strip(F.col(c).cast("string"))
    score = F.col("confidence_score").cast("double") if "confidence_score" in golden.columns else F.lit(1.0)
    side = golden.select(
        F.col("tenant_id").alias(tenant), "cluster_id", "golden_id", score.alias("_score"), *[text(c).alias(f"_g_{c}") for c in attributes]
    )
    source = F.col("source_id").cast("string") if "source_id" in records.columns else F.lit(None).cast("string")
    rows = records.select(
        *key, F.struct(F.col(id_col).cast("string").alias("id"), F.coalesce(source, F.lit("unknown")).alias("source")).alias("_rec"),
        *[text(c).alias(f"_r_{c}") for c in attributes],
    ).join(side, key)
    first = F.min("_rec")
    found = [F.min(F.when(F.col(f"_r_{c}") == F.col(f"_g_{c}"), F.col("_rec"))).alias(f"_f_{c}") for c in attributes]
    per_cluster = rows.groupBy("golden_id", tenant, "_score", *[f"_g_{c}" for c in attributes]).agg(first.alias("_first"), *found)
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.col(f"_g_{c}").alias("value"), F.coalesce(f"_f_{c}", "_first").alias("rec"))
            for c in attributes
        ]
    )
    made = created_at if created_at is not None else F.current_timestamp()
    return (
        per_cluster.withColumn("_e", F.explode(entries))
        .filter("_e.value <> ''")
        .select(
            F.sha2(F.concat_ws(":", "golden_id", "_e.name"), 256).alias("id"), "golden_id", F.col(tenant).alias("tenant_id"),
            F.col("_e.name").alias("attribute_name"), F.col("_e.value").alias("attribute_value"),
            F.col("_e.rec.id").alias("source_record_id"), F.col("_e.rec.source").alias("source_id"),
            F.col("_score").alias("confidence_score"), made.alias("created_at"),
        )
    )
