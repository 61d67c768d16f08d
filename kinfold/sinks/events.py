"""Events out: ``(key, value)`` frames for Kafka, or for files where there is no broker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.golden import HEAD


def batch_summary(staged: DataFrame, staging_path: str, at: Column) -> DataFrame:
    """One row per tenant, source and batch: the body of an ``ingest.valid`` event."""
    return staged.groupBy("tenant_id", "source_id", "batch_id").agg(F.count("*").alias("record_count")).select(
        "tenant_id", "source_id", "batch_id", F.lit("valid").alias("status"), F.lit(staging_path).alias("staging_path"), "record_count",
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx").alias("timestamp"),
    )


def ingest_valid_events(summary: DataFrame, entity_type: Column) -> DataFrame:
    """Key ``tenant:entity_type``, value the batch summary."""
    key = F.concat_ws(":", F.col("tenant_id"), entity_type)
    return summary.select(key.alias("key"), F.to_json(F.struct(*summary.columns)).alias("value"))


def entity_resolved_events(golden: DataFrame, entity_type: Column) -> DataFrame:
    """Key ``tenant:golden_id``, value ``{tenant_id, golden_id, entity_type, data}`` with all attributes in ``data``."""
    data = F.struct(*[c for c in golden.columns if c not in HEAD and c != "cluster_id"])
    body = F.struct("tenant_id", "golden_id", entity_type.alias("entity_type"), data.alias("data"))
    return golden.select(F.concat_ws(":", "tenant_id", "golden_id").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def entity_updated_events(events: DataFrame) -> DataFrame:
    """Key the entity, value ``{tenantId, entityId, changeType, occurredAt}``."""
    return events.select("key", F.to_json(F.struct("tenantId", "entityId", "changeType", "occurredAt")).alias("value"))


def publish(events: DataFrame, topic: str, servers: str | None = None, path: str | None = None) -> None:
    """Write events to a topic, or as files when no broker is named. The producer waits for all replicas."""
    if servers:
        writer = events.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        writer.option("kafka.acks", "all").option("kafka.enable.idempotence", "true").save()
    elif path:
        events.write.mode("append").parquet(f"{path}/{topic}")
    else:
        raise ValueError("publish needs servers or a path")
