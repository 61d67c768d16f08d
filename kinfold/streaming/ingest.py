"""Streaming intake: messages to raw zone, dead letters and, on a batch-complete signal, staged batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..plans.intake import intake
from ..session import materialize, release
from ..sinks.tables import write_counted, write_staged
from ..sources.messages import dead_letters, decode, explode_rows, good_messages


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_TEXT, _LONG = T.StringType(), T.LongType()
RUN_SCHEMA = _schema(
    tenant_id=_TEXT, source_id=_TEXT, stream_batch=_LONG, status=_TEXT, records_input=_LONG, records_output=_LONG, records_failed=_LONG,
    error_message=_TEXT,
)
SCOPE = ["tenant_id", "source_id"]
# Tries after the first, and the pause between them.
RETRIES, WAIT_SECONDS = 3, 0.5
STAGED_SCHEMA = _schema(tenant_id=_TEXT, source_id=_TEXT, batch_id=_TEXT)


@dataclass(frozen=True)
class IntakePaths:
    """Folders of the intake below one root in shared storage."""

    root: str

    raw = property(lambda self: f"{self.root}/raw")
    signals = property(lambda self: f"{self.root}/signals")
    dead = property(lambda self: f"{self.root}/dead_letter")
    failed = property(lambda self: f"{self.root}/dead_letter_rows")
    staged = property(lambda self: f"{self.root}/staged")
    rejected = property(lambda self: f"{self.root}/rejected")
    runs = property(lambda self: f"{self.root}/pipeline_runs")
    checkpoint = property(lambda self: f"{self.root}/checkpoint")


def _raw_schema(columns: Sequence[str]) -> T.StructType:
    return _schema(tenant_id=_TEXT, source_id=_TEXT, event_id=_TEXT, **dict.fromkeys(columns, _TEXT), stream_batch=_LONG)


def prepare(spark: SparkSession, paths: IntakePaths, columns: Sequence[str]) -> None:
    """Create the folders the handler reads back; existing ones stay as they are."""
    for path, schema, parts in (
        (paths.runs, RUN_SCHEMA, ["stream_batch"]), (paths.raw, _raw_schema(columns), ["tenant_id", "source_id", "stream_batch"]),
        (paths.staged, STAGED_SCHEMA, STAGED_SCHEMA.fieldNames()), (paths.rejected, STAGED_SCHEMA, STAGED_SCHEMA.fieldNames()),
    ):
        keyed = schema if parts != STAGED_SCHEMA.fieldNames() else T.StructType([*schema.fields, T.StructField("id", T.StringType())])
        spark.createDataFrame([], keyed).write.mode("ignore").partitionBy(*parts).parquet(path)


def _table(df: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    return df.sparkSession.read.schema(schema).parquet(path)


def _open_rows(signals: DataFrame, paths: IntakePaths, columns: Sequence[str], batch: int) -> DataFrame:
    """The raw rows of the signalled sources that no run has dealt with, with the ``batch_id`` their run stages under.

    The name comes from the first micro-batch a source has open, so a run that is tried again, now or at a later signal,
    replaces what an earlier try has left. The raw zone is partitioned by tenant, source and micro-batch: the folders of
    other sources are left out through the join, those before the first open micro-batch by a bound.
    """
    runs = _table(signals, paths.runs, RUN_SCHEMA).filter(F.col("status").isin("COMPLETED", "FAILED") & (F.col("stream_batch") < batch))
    since = runs.groupBy(*SCOPE).agg(F.max("stream_batch").alias("_since"))
    asked = signals.select(*SCOPE).distinct().join(since, SCOPE, "left").withColumn("_since", F.coalesce("_since", F.lit(-1).cast("bigint")))
    asked = materialize(asked.withColumn("batch_id", F.concat(F.lit("from-"), (F.col("_since") + 1).cast("string"))))
    first = asked.agg(F.min("_since")).first()[0]
    raw = _table(signals, paths.raw, _raw_schema(columns)).filter((F.col("stream_batch") <= batch) & (F.col("stream_batch") > (-1 if first is None else first)))
    return raw.join(asked, SCOPE).filter(F.col("stream_batch") > F.col("_since")).drop("_since")


def _stage(piece: DataFrame, signals: DataFrame, paths: IntakePaths, batch: int) -> None:
    result = intake(piece.drop("stream_batch", "event_id"), SCOPE, store=True)
    write_staged(result.valid, paths.staged)
    write_staged(result.invalid, paths.rejected)
    names = piece.select(*SCOPE, "batch_id").distinct()
    size = lambda df, c: df.groupBy(*SCOPE).agg(F.count("*").alias(c))
    written = lambda path: _table(signals, path, STAGED_SCHEMA).join(names, [*SCOPE, "batch_id"], "left_semi")
    report = (
        signals.select(*SCOPE).distinct()
        .join(size(piece, "records_input"), SCOPE, "left")
        .join(size(written(paths.staged), "records_output"), SCOPE, "left")
        .join(size(written(paths.rejected), "records_failed"), SCOPE, "left")
        .na.fill(0).withColumns({"status": F.lit("COMPLETED"), "error_message": F.lit(None).cast("string")})
    )
    _record_runs(report, paths, batch)


def _give_up(piece: DataFrame, signals: DataFrame, paths: IntakePaths, columns: Sequence[str], batch: int, reason: str) -> None:
    """Route the rows of a run that failed for good to the dead letters and take back what it has staged."""
    spark = signals.sparkSession
    part = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    # a row for each source signalled in this micro-batch
    for row in piece.select(*SCOPE, "batch_id").distinct().collect():
        folder = "/".join(part(c, row[c]) for c in (*SCOPE, "batch_id"))
        release(spark, f"{paths.staged}/{folder}", f"{paths.rejected}/{folder}")
    lost = piece.select(F.col("tenant_id").alias("key"), F.to_json(F.struct(*SCOPE, "event_id", *columns)).alias("raw_value"), F.lit(reason).alias("reason"), F.lit(batch).cast("bigint").alias("stream_batch"))
    write_counted(lost, paths.failed, ["stream_batch"], "overwrite")
    counts = piece.groupBy(*SCOPE).agg(F.count("*").alias("records_input"))
    failed = signals.select(*SCOPE).distinct().join(counts, SCOPE, "left").na.fill(0).withColumns(
        {"records_output": F.lit(0).cast("bigint"), "records_failed": F.col("records_input"), "status": F.lit("FAILED"), "error_message": F.lit(reason)}
    )
    _record_runs(failed, paths, batch)


def complete_batches(signals: DataFrame, paths: IntakePaths, columns: Sequence[str], batch: int) -> None:
    """Clean, de-duplicate, validate and stage the open raw rows of all signalled sources in one job.

    A run that fails is tried ``RETRIES`` times more, ``WAIT_SECONDS`` apart. Then its rows go to the dead letters with
    the reason, the run is recorded as FAILED, and the stream goes on.
    """
    piece = _open_rows(signals, paths, columns, batch)
    for attempt in range(RETRIES + 1):
        try:
            return _stage(piece, signals, paths, batch)
        except Exception as error:  # noqa: BLE001 - a failed run is a result, the stream goes on
            if attempt == RETRIES:
                return _give_up(piece, signals, paths, columns, batch, str(error))
            time.sleep(WAIT_SECONDS)


def _record_runs(report: DataFrame, paths: IntakePaths, batch: int) -> None:
    rows = report.withColumn("stream_batch", F.lit(batch).cast("bigint")).select(*RUN_SCHEMA.fieldNames())
    write_counted(rows, paths.runs, ["stream_batch"], "overwrite")


def intake_batch(paths: IntakePaths, columns: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function of the intake stream."""

    ready: list[bool] = []

    def handle(messages: DataFrame, batch: int) -> None:
        if not ready:
            prepare(messages.sparkSession, paths, columns)
            ready.append(True)
        where = [c for c in ("topic", "partition", "offset") if c in messages.columns]
        decoded = decode(messages, where).persist()
        try:
            tag = lambda df: df.withColumn("stream_batch", F.lit(batch).cast("bigint"))
            write_counted(tag(dead_letters(decoded)), paths.dead, ["stream_batch"], "overwrite")
            write_counted(tag(explode_rows(decoded, columns)), paths.raw, [*SCOPE, "stream_batch"], "overwrite")
            signals = good_messages(decoded).filter("batch_complete").select("tenant_id", "source_id").distinct()
            write_counted(tag(signals), paths.signals, ["stream_batch"], "overwrite")
            if not signals.isEmpty():
                complete_batches(signals, paths, columns, batch)
        finally:
            decoded.unpersist()

    return handle


def intake_stream(messages: DataFrame, paths: IntakePaths, columns: Sequence[str]) -> DataStreamWriter:
    """Start-ready writer over a message stream (``key``, ``value`` and, from Kafka, topic, partition, offset).

    Delivery is at least once; every output of a micro-batch overwrites the folder of that micro-batch, so replays do
    not repeat rows.
    """
    return messages.writeStream.foreachBatch(intake_batch(paths, columns)).option("checkpointLocation", paths.checkpoint)


def drop_repeated(messages: DataFrame, time_column: str, key: Sequence[str] = ("event_id",), delay: str = "10 minutes") -> DataFrame:
    """Suppress repeated messages by key; the state of a key is dropped once the watermark has passed it."""
    return messages.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(list(key))
