"""Pipeline-run lists, derived columns and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Run states shown by the monitor, and what an unknown connector is called.
STATUSES = ("RUNNING", "CLEANED", "COMPLETED", "FAILED")
NO_NAME, NO_TYPE = "Pipeline", "Database"


def runs_with_status(runs: DataFrame, status: str | None = None) -> DataFrame:
    """Runs of one status, any case; blank or ALL keeps every run."""
    if status is None or not status.strip() or status.upper() == "ALL":
        return runs
    return runs.filter(F.col("status") == status.upper())


def with_connector(runs: DataFrame, connectors: DataFrame) -> DataFrame:
    """Add ``connector_name`` and ``connector_type``; a missing connector reads as a database pipeline.

    The join is left to adaptive execution, which broadcasts the connectors once it has seen that they are small.
    """
    side = connectors.select(F.col("id").alias("connection_id"), F.col("name").alias("_name"), F.col("type").alias("_type"))
    return runs.join(side, "connection_id", "left").withColumns(
        {"connector_name": F.coalesce("_name", F.lit(NO_NAME)), "connector_type": F.coalesce("_type", F.lit(NO_TYPE))}
    ).drop("_name", "_type")


def with_progress(runs: DataFrame, now: Column) -> DataFrame:
    """Add ``duration_seconds``, ``progress`` (percent) and ``throughput`` (records per second of a running job)."""
    end = F.coalesce(F.col("completed_at"), now)
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), end)
    duration = F.when(F.col("started_at").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), seconds)).cast("bigint")
    done = F.col("records_output").cast("double")
    progress = (
        F.when(F.col("records_input") > 0, F.least(F.lit(100.0), done / F.nullif(F.col("records_input"), F.lit(0)) * 100.0))
        .when(F.upper("status") == "COMPLETED", F.lit(100.0))
        .otherwise(F.lit(0.0))
    )
    running = (F.col("duration_seconds") > 0) & (F.col("records_output") > 0) & (F.upper("status") == "RUNNING")
    return runs.withColumns({"duration_seconds": duration, "progress": progress}).withColumn(
        "throughput", F.when(running, done / F.nullif(F.col("duration_seconds"), F.lit(0))).otherwise(F.lit(0.0))
    )


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc_nulls_last(), "id")


def run_metrics(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: cleaned, resolved, active, failed and all runs. Two map-side aggregates of one row each."""
    of_runs = runs.agg(
        F.coalesce(F.sum("records_output"), F.lit(0)).alias("total_records_cleaned"),
        F.count_if(F.col("status") == "RUNNING").alias("active_jobs"),
        F.coalesce(F.sum("records_failed"), F.lit(0)).alias("total_records_failed"),
        F.count("*").alias("total_runs"),
    )
    resolved = candidates.agg(F.count_if(F.col("status") == "ACCEPTED"))
    return of_runs.withColumn("total_entities_resolved", resolved.scalar())


def monitor_totals(runs: DataFrame) -> DataFrame:
    """One row: throughput of running jobs, records in and failed, runs per status and ALL."""
    total = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return runs.agg(
        total(F.sum(F.when(F.col("status") == "RUNNING", F.col("throughput"))), "total_throughput"),
        total(F.sum("records_input"), "total_input"),
        total(F.sum("records_failed"), "total_failed"),
        F.count("*").alias("count_all"),
        *[F.count_if(F.col("status") == s).alias(f"count_{s.lower()}") for s in STATUSES],
    )


def sync_totals(datasets: DataFrame) -> DataFrame:
    """One row: total, synced and failed records over datasets and the synced share in percent."""
    return datasets.agg(
        F.coalesce(F.sum("total_records"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum("synced_records"), F.lit(0)).alias("total_synced"),
        F.coalesce(F.sum("failed_records"), F.lit(0)).alias("total_failed"),
    ).withColumn(
        "overall_percent",
        F.when(F.col("total_records") > 0, F.col("total_synced") / F.nullif(F.col("total_records"), F.lit(0)) * 100.0).otherwise(F.lit(0.0)),
    )
