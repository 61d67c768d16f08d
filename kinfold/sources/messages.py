"""Envelopes of the ``ingest.raw`` topic: packing rows into messages and reading them back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paging import numbered

# Rows per message, and the envelope in the producer's and the consumer's spelling.
CHUNK_SIZE = 1000
ENVELOPE = (
    "eventId string, tenantId string, connectionId string, source string, ingestedAt string, totalRows bigint, "
    "tenant_id string, source_id string, row_count bigint, total_rows bigint, batch_complete boolean, "
    "rows array<map<string,string>>, _corrupt_record string"
)



def read_topic(spark: SparkSession, servers: str, topic: str = "ingest.raw") -> DataFrame:
    """Stream of raw messages from the beginning of the topic; the checkpoint of the query takes the place of commits."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").load()
    )


def pack_rows(df: DataFrame, columns: Sequence[str], ingested_at: Column, tenant: str = "tenant_id", connection: str = "connection_id",
              source: str = "source", order_by: str = "id", size: int = CHUNK_SIZE) -> DataFrame:
    """``(key, value)`` messages of up to ``size`` rows: key is the tenant, value the JSON envelope.

    A source is cut in the order of ``order_by``, every ``size`` rows, whatever its length; rows are numbered by ranges,
    so no task orders a whole source.
    """
    group = [tenant, connection, source]
    row = F.struct(*[F.col(c).cast("string").alias(c) for c in columns])
    chunked = numbered(df, group, [order_by]).withColumn("_chunk", F.expr(f"(_number - 1) div {size}"))
    packed = chunked.groupBy(*group, "_chunk").agg(
        F.count("*").alias("totalRows"),
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("_number").alias("at"), row.alias("row")))), lambda x: x["row"]).alias("rows"),
    )
    event = F.sha2(F.concat_ws(":", *group, F.col("_chunk").cast("string")), 256)
    envelope = F.struct(
        event.alias("eventId"), F.col(tenant).alias("tenantId"), F.col(connection).alias("connectionId"), F.col(source).alias("source"),
        F.date_format(ingested_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingestedAt"), "totalRows", "rows",
    )
    return packed.select(F.col(tenant).alias("key"), F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value"))


def decode(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Read envelopes in either spelling, one row per message, with ``problem`` set for what cannot be read.

    Missing tenant and source read as ``unknown``, a missing count as 0, a missing value as an empty object.
    """
    raw = F.coalesce(F.col("value").cast("string"), F.lit("{}"))
    parsed = messages.select(*keep, F.col("key").cast("string").alias("key"), raw.alias("raw_value")).withColumn(
        "_e", F.from_json("raw_value", ENVELOPE, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    )
    bad = F.col("_e").isNull() | F.col("_e._corrupt_record").isNotNull() | ~F.ltrim("raw_value").startswith("{")
    count = F.coalesce(F.col("_e.row_count"), F.col("_e.totalRows"), F.col("_e.total_rows"), F.lit(0).cast("bigint"))
    return parsed.select(
        *keep, "key", "raw_value",
        F.when(bad, F.lit("value is not a JSON envelope")).alias("problem"),
        F.col("_e.eventId").alias("event_id"),
        F.coalesce("_e.tenant_id", "_e.tenantId", F.lit("unknown")).alias("tenant_id"),
        F.coalesce("_e.source_id", "_e.connectionId", F.lit("unknown")).alias("source_id"),
        F.col("_e.source").alias("source"),
        count.alias("row_count"),
        F.coalesce("_e.batch_complete", F.lit(False)).alias("batch_complete"),
        F.col("_e.rows").alias("rows"),
    )


def good_messages(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("problem").isNull())


def dead_letters(decoded: DataFrame) -> DataFrame:
    """Messages that cannot be read, with the reason and where they came from."""
    where = [c for c in ("topic", "partition", "offset") if c in decoded.columns]
    return decoded.filter(F.col("problem").isNotNull()).select(*where, "key", "raw_value", F.col("problem").alias("reason"))


def explode_rows(decoded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per record of the readable messages, the named fields as text columns; absent fields are null."""
    rows = good_messages(decoded).withColumn("_row", F.explode("rows"))
    return rows.select("tenant_id", "source_id", "event_id", *[F.col("_row")[c].alias(c) for c in columns])
