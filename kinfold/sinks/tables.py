"""Tables out: staged batches, staging rows, review candidates, golden records, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.golden import HEAD


def _json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _first_of(df: DataFrame, *names: str, default: str = "") -> Column:
    known = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*known, F.lit(default))


def write_counted(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "append") -> int:
    """Write and return the number of rows, counted on the way out instead of by a second pass."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return int(seen.get["rows"])


def write_staged(df: DataFrame, root: str, tenant_id: str | None = None, source_id: str | None = None, batch_id: str | None = None) -> int:
    """One folder per tenant, source and batch. A rerun of a batch replaces its folder and touches no other."""
    for name, value in (("tenant_id", tenant_id), ("source_id", source_id), ("batch_id", batch_id)):
        if value is not None:
            df = df.withColumn(name, F.lit(value))
    return write_counted(df, root, ["tenant_id", "source_id", "batch_id"], "overwrite")


def staging_records(df: DataFrame, tenant_id: Column, source_id: Column, batch_id: Column, staged_at: Column) -> DataFrame:
    """Rows of ``staging_records``: the whole row as JSON under a key that is stable across reruns of the batch."""
    raw_id = _first_of(df, "id")
    data = _json(df.columns)
    return df.select(
        F.sha2(F.concat_ws(":", tenant_id, source_id, batch_id, raw_id, data), 256).alias("id"),
        tenant_id.alias("tenant_id"), source_id.alias("source_id"), raw_id.alias("raw_id"), data.alias("data"), staged_at.alias("staged_at"),
    )


def review_candidates(review: DataFrame, tenant_id: Column, created_at: Column) -> DataFrame:
    """Rows of ``er_candidates`` for pairs to be judged by a person; status PENDING."""
    a, b = _first_of(review, "id_a", "id_1"), _first_of(review, "id_b", "id_2")
    score = F.coalesce(F.col("confidence_score").cast("double"), F.lit(0.0)) if "confidence_score" in review.columns else F.lit(0.0)
    return review.select(
        F.sha2(F.concat_ws(":", tenant_id, a, b), 256).alias("id"), tenant_id.alias("tenant_id"), a.alias("record_id_a"), b.alias("record_id_b"),
        score.alias("confidence_score"), _json(review.columns).alias("payload"), F.lit("PENDING").alias("status"), created_at.alias("created_at"),
    )


def golden_rows(golden: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Rows of ``golden_records``: head columns, and the other columns as JSON ``attributes``. Members are rows of their own
    (``golden_members``), so that a cluster may have any number of them."""
    attributes = [c for c in golden.columns if c not in HEAD and c != "cluster_id"]
    return golden.select(
        "golden_id", "tenant_id", F.col("cluster_size").cast("int").alias("cluster_size"),
        _json(attributes).alias("attributes"),
        (created_at if created_at is not None else F.col("created_at")).alias("created_at"),
    )


def provenance_rows(provenance: DataFrame) -> DataFrame:
    """Rows of ``provenance`` with its defaults filled in."""
    return provenance.select(
        "id", "golden_id", "tenant_id", "attribute_name", "attribute_value",
        F.coalesce("source_record_id", F.lit("unknown")).alias("source_record_id"), F.coalesce("source_id", F.lit("unknown")).alias("source_id"),
        F.coalesce(F.col("confidence_score").cast("double"), F.lit(1.0)).alias("confidence_score"), "created_at",
    )
