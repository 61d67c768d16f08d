"""Analyst decisions applied as a batch: accept, reject, split.

State is three tables: candidates, golden records (``golden_id``, ``tenant_id``, ``properties`` map, ``version``) and
their members (``golden_id``, ``tenant_id``, ``source_record_id``), one row per member.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .dedup import dedup_exact

# Candidate states, provenance actions and change types of entity events.
PENDING, ACCEPTED, REJECTED = "PENDING", "ACCEPTED", "REJECTED"
FIELD_MERGE, MERGE_ACCEPT, SPLIT_REMOVE, SPLIT_CREATE = "FIELD_MERGE", "MERGE_ACCEPT", "SPLIT_REMOVE", "SPLIT_CREATE"
EVENT_MERGE, EVENT_SPLIT, EVENT_SPLIT_CREATED = "GOLDEN_RECORD_MERGE", "GOLDEN_RECORD_SPLIT", "GOLDEN_RECORD_CREATED_FROM_SPLIT"


@dataclass(frozen=True)
class ReviewResult:
    candidates: DataFrame
    golden: DataFrame
    members: DataFrame
    log: DataFrame
    events: DataFrame
    conflicts: DataFrame


def judge_decisions(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions with the candidate's state and ``problem``: null when the decision can be applied.

    Only a PENDING candidate can be decided; of several decisions on one candidate the first counts.
    """
    first = dedup_exact(decisions, ["candidate_id"], ["decided_at", "decision"]).select(
        "candidate_id", F.col("decided_at").alias("_first_at"), F.col("decision").alias("_first")
    )
    state = candidates.select(F.col("id").alias("candidate_id"), "status")
    later = ~(F.col("decided_at").eqNullSafe(F.col("_first_at")) & F.col("decision").eqNullSafe(F.col("_first")))
    done = F.when(F.col("_first") == "ACCEPT", F.lit(ACCEPTED)).otherwise(F.lit(REJECTED))
    return (
        decisions.join(first, "candidate_id", "left")
        .join(state, "candidate_id", "left")
        .withColumn(
            "problem",
            F.when(F.col("status").isNull(), F.lit("candidate not found"))
            .when(F.col("status") != PENDING, F.concat(F.lit("candidate is already "), "status"))
            .when(later, F.concat(F.lit("candidate is already "), done)),
        )
        .drop("_first", "_first_at")
    )


def conflict_report(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions that cannot be applied, with the reason."""
    return judge_decisions(decisions, candidates).filter(F.col("problem").isNotNull()).select("candidate_id", "decision", "problem")


def _fields(df: DataFrame, key: list[str], snapshot: str) -> DataFrame:
    return df.select(*key, F.explode(snapshot).alias("field_name", "value")).filter(~is_blank(F.col("value")))


def merged_fields(accepted: DataFrame, golden: DataFrame) -> DataFrame:
    """``(golden_id, field_name, value)`` after all accepted merges.

    A golden value that is not blank stays; else the first accepted non-blank value fills it. One aggregate, combined on
    the map side, gives what a merge per decision would give, however many decisions a golden record has.
    """
    order = F.struct("decided_at", "candidate_id")
    incoming = _fields(accepted, ["golden_id", "decided_at", "candidate_id"], "record_b_snapshot")
    first = incoming.groupBy("golden_id", "field_name").agg(F.min_by("value", order).alias("incoming"))
    current = golden.select("golden_id", F.explode("properties").alias("field_name", "current"))
    both = first.join(current, ["golden_id", "field_name"], "full")
    keep = F.when(is_blank(F.col("current")), F.coalesce("incoming", "current")).otherwise(F.col("current"))
    return both.select("golden_id", "field_name", keep.alias("value"))


def _accepted(judged: DataFrame, candidates: DataFrame) -> DataFrame:
    return (
        judged.filter(F.col("problem").isNull() & (F.col("decision") == "ACCEPT"))
        .select("candidate_id", "decided_at")
        .join(candidates.withColumnRenamed("id", "candidate_id").drop("status"), "candidate_id")
        .select("candidate_id", "decided_at", "tenant_id", F.col("golden_record_id").alias("golden_id"), "record_b_id", "record_b_snapshot")
    )


def merge_log(accepted: DataFrame, fields: DataFrame) -> DataFrame:
    """Provenance rows: FIELD_MERGE for every incoming field equal to the final value, one MERGE_ACCEPT per decision."""
    key = ["golden_id", "record_b_id", "candidate_id", "decided_at"]
    names = [F.col("record_b_id").alias("source_record_id"), "field_name", "candidate_id", "action", F.col("decided_at").alias("occurred_at")]
    same = _fields(accepted, key, "record_b_snapshot").join(fields.withColumnRenamed("value", "_final"), ["golden_id", "field_name"])
    merged = same.filter(F.col("value") == F.col("_final")).withColumn("action", F.lit(FIELD_MERGE))
    whole = accepted.withColumns({"field_name": F.lit(None).cast("string"), "action": F.lit(MERGE_ACCEPT)})
    return merged.select("golden_id", *names).unionByName(whole.select("golden_id", *names))


def entity_events(df: DataFrame, change_type: Column, entity_id: str = "golden_id", occurred_at: str = "occurred_at") -> DataFrame:
    """``entity.updated`` events: key and the four fields of the value."""
    return df.select(
        F.col(entity_id).alias("key"), F.col("tenant_id").alias("tenantId"), F.col(entity_id).alias("entityId"),
        change_type.alias("changeType"), F.col(occurred_at).alias("occurredAt"),
    )


def apply_decisions(decisions: DataFrame, candidates: DataFrame, golden: DataFrame, members: DataFrame) -> ReviewResult:
    """Apply ACCEPT and REJECT decisions (``candidate_id, decision, decided_at, decided_by``)."""
    judged = judge_decisions(decisions, candidates)
    valid = judged.filter(F.col("problem").isNull())
    state = valid.select(
        F.col("candidate_id").alias("id"), F.when(F.col("decision") == "ACCEPT", F.lit(ACCEPTED)).otherwise(F.lit(REJECTED)).alias("_new"),
        F.col("decided_at").alias("_at"), F.col("decided_by").alias("_by"),
    )
    reviewed = candidates.drop("reviewed_at", "reviewed_by").join(state, "id", "left").withColumns(
        {"status": F.coalesce("_new", "status"), "reviewed_at": F.col("_at"), "reviewed_by": F.col("_by")}
    ).drop("_new", "_at", "_by")

    accepted = _accepted(judged, candidates)
    fields = merged_fields(accepted, golden)
    # one row per field and golden record by now, so a map has at most as many entries as there are fields
    properties = fields.groupBy("golden_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_name", "value")))).alias("_properties")
    )
    touched = accepted.groupBy("golden_id").agg(F.count("*").alias("_merges"))
    merged = golden.join(properties, "golden_id", "left").join(touched, "golden_id", "left").withColumns(
        {"properties": F.coalesce("_properties", "properties"), "version": F.col("version") + F.coalesce("_merges", F.lit(0))}
    ).drop("_properties", "_merges")
    joined = members.unionByName(
        accepted.select("golden_id", "tenant_id", F.col("record_b_id").alias("source_record_id"))
    ).distinct()
    return ReviewResult(
        candidates=reviewed, golden=merged, members=joined, log=merge_log(accepted, fields),
        events=entity_events(accepted, F.lit(EVENT_MERGE), occurred_at="decided_at"),
        conflicts=judged.filter(F.col("problem").isNotNull()).select("candidate_id", "decision", "problem"),
    )


def judge_splits(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Split requests (``golden_id, source_record_id, requested_at``) with ``problem``, null when the split can be done.

    Requests on one golden record are taken in order: a record can leave once, and the last member cannot leave. When
    all members are asked for, it is therefore the latest valid request that fails.
    """
    pair = ["golden_id", "source_record_id"]
    first = requests.groupBy(*pair).agg(F.min("requested_at").alias("_first_at"))
    sizes = members.groupBy("golden_id").agg(F.count("*").alias("_size"))
    known = members.select(*pair, "tenant_id").withColumn("_member", F.lit(True))
    judged = requests.join(first, pair).join(known, pair, "left").join(sizes, "golden_id", "left")
    valid = judged.filter("_member AND requested_at <=> _first_at").groupBy("golden_id").agg(
        F.count("*").alias("_asked"), F.max(F.struct("requested_at", "source_record_id")).alias("_last")
    )
    last = F.struct("requested_at", "source_record_id") == F.col("_last")
    problem = (
        F.when(F.col("_size").isNull(), F.lit("golden record not found"))
        .when(F.col("_member").isNull() | ~F.col("requested_at").eqNullSafe(F.col("_first_at")), F.lit("source record is not part of golden record"))
        .when((F.col("_asked") >= F.col("_size")) & last, F.lit("golden record has only one source record"))
    )
    return judged.join(valid, "golden_id", "left").select(*pair, "requested_at", "tenant_id", problem.alias("problem"))


def split_golden_id(golden: Column, source: Column) -> Column:
    return F.concat(F.lit("gr-"), F.sha2(F.concat_ws(":", golden, source), 256))


def apply_splits(requests: DataFrame, golden: DataFrame, members: DataFrame) -> ReviewResult:
    """Move each requested record to a golden record of its own that starts with a copy of the current properties."""
    judged = judge_splits(requests, members)
    done = judged.filter(F.col("problem").isNull()).withColumn("_new", split_golden_id(F.col("golden_id"), F.col("source_record_id")))
    created = done.select("golden_id", "_new").join(golden, "golden_id").withColumns({"golden_id": F.col("_new"), "version": F.lit(0).cast(golden.schema["version"].dataType)})
    taken = done.groupBy("golden_id").agg(F.count("*").alias("_splits"))
    kept = golden.join(taken, "golden_id", "left").withColumn("version", F.col("version") + F.coalesce("_splits", F.lit(0))).drop("_splits")
    moved = members.join(done.select("golden_id", "source_record_id"), ["golden_id", "source_record_id"], "left_anti").unionByName(
        done.select(F.col("_new").alias("golden_id"), "tenant_id", "source_record_id")
    )
    side = lambda gid, action: done.select(
        F.col(gid).alias("golden_id"), "source_record_id", F.lit(None).cast("string").alias("field_name"),
        F.lit(None).cast("string").alias("candidate_id"), F.lit(action).alias("action"), F.col("requested_at").alias("occurred_at"),
    )
    event = lambda gid, kind: entity_events(done, F.lit(kind), gid, "requested_at")
    return ReviewResult(
        candidates=requests.limit(0), golden=kept.unionByName(created.select(*golden.columns)), members=moved,
        log=side("golden_id", SPLIT_REMOVE).unionByName(side("_new", SPLIT_CREATE)),
        events=event("golden_id", EVENT_SPLIT).unionByName(event("_new", EVENT_SPLIT_CREATED)),
        conflicts=judged.filter(F.col("problem").isNotNull()).select("golden_id", "source_record_id", "problem"),
    )


def list_candidates(candidates: DataFrame, status: str | None = None) -> DataFrame:
    """List view: optionally one status, without the comparison details."""
    listed = candidates.filter(F.col("status") == status) if status else candidates
    return listed.drop("comparison_details")


def candidate_detail(candidates: DataFrame, candidate_id: str) -> DataFrame:
    """All columns of one candidate; empty when there is none."""
    return candidates.filter(F.col("id") == candidate_id)
