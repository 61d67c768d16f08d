import datetime

from pyspark.sql import functions as F

from kinfold.operators import review

T0 = datetime.datetime(2026, 1, 1)
CAND = "id string, tenant_id string, golden_record_id string, record_a_id string, record_b_id string, record_b_snapshot map<string,string>, status string"
GOLD = "golden_id string, tenant_id string, properties map<string,string>, version bigint"
MEMB = "golden_id string, tenant_id string, source_record_id string"


def state(spark):
    snapshot = {"name": "Ann", "phone": "123", "city": "Rome", "note": " "}
    candidates = spark.createDataFrame(
        [("c1", "t", "g1", "a", "b", snapshot, "PENDING"), ("c2", "t", "g1", "a", "d", {"phone": "999", "note": "hi"}, "PENDING"), ("c3", "t", "g1", "a", "e", {}, "REJECTED"), ("c4", "t", "g2", "x", "y", {}, "PENDING")], CAND)
    golden = spark.createDataFrame([("g1", "t", {"name": "Ann", "phone": None, "city": "Oslo"}, 3), ("g2", "t", {"name": "Bo"}, 0)], GOLD)
    members = spark.createDataFrame([("g1", "t", "a"), ("g1", "t", "z"), ("g2", "t", "x")], MEMB)
    return candidates, golden, members


def decide(spark, *rows):
    return spark.createDataFrame([(c, d, T0 + datetime.timedelta(hours=h), "me") for c, d, h in rows], "candidate_id string, decision string, decided_at timestamp, decided_by string")


def test_accept_merges_what_does_not_conflict(spark):
    done = review.apply_decisions(decide(spark, ("c1", "ACCEPT", 1)), *state(spark))
    g1 = done.golden.filter("golden_id = 'g1'").first()
    assert g1["properties"] == {"name": "Ann", "phone": "123", "city": "Oslo"} and g1["version"] == 4
    assert sorted((r["field_name"] or "", r["action"]) for r in done.log.collect()) == [("", "MERGE_ACCEPT"), ("name", "FIELD_MERGE"), ("phone", "FIELD_MERGE")]
    assert {r["source_record_id"] for r in done.members.filter("golden_id = 'g1'").collect()} == {"a", "z", "b"}
    assert [(r["entityId"], r["changeType"]) for r in done.events.collect()] == [("g1", "GOLDEN_RECORD_MERGE")]
    assert done.candidates.filter("id = 'c1'").first()["status"] == "ACCEPTED"


def test_two_accepts_on_one_golden_record_follow_their_order(spark):
    done = review.apply_decisions(decide(spark, ("c1", "ACCEPT", 2), ("c2", "ACCEPT", 1)), *state(spark))
    g1 = done.golden.filter("golden_id = 'g1'").first()
    assert g1["properties"]["phone"] == "999" and g1["properties"]["note"] == "hi" and g1["version"] == 5
    merged = {(r["candidate_id"], r["field_name"]) for r in done.log.filter("action = 'FIELD_MERGE'").collect()}
    assert merged == {("c1", "name"), ("c2", "phone"), ("c2", "note")}


def test_conflicts_become_rows(spark):
    asked = decide(spark, ("c1", "REJECT", 1), ("c1", "ACCEPT", 2), ("c3", "ACCEPT", 1), ("nope", "ACCEPT", 1))
    done = review.apply_decisions(asked, *state(spark))
    assert sorted((r["candidate_id"], r["problem"]) for r in done.conflicts.collect()) == [
        ("c1", "candidate is already REJECTED"), ("c3", "candidate is already REJECTED"), ("nope", "candidate not found")]
    assert done.golden.filter("golden_id = 'g1'").first()["version"] == 3 and done.log.count() == 0


def test_split(spark):
    _, golden, members = state(spark)
    asked = spark.createDataFrame([("g1", "z", 1), ("g2", "x", 1), ("g1", "q", 1), ("g9", "a", 1), ("g1", "z", 5)], "golden_id string, source_record_id string, requested_at int")
    done = review.apply_splits(asked, golden, members)
    sizes = {r["golden_id"]: r["count"] for r in done.members.groupBy("golden_id").count().collect()}
    assert sorted(sizes.values()) == [1, 1, 1] and sizes["g1"] == 1
    fresh = done.golden.filter(~F.col("golden_id").isin("g1", "g2")).collect()
    assert len(fresh) == 1 and fresh[0]["properties"]["name"] == "Ann" and fresh[0]["properties"]["city"] == "Oslo"
    assert {(r["golden_id"], r["source_record_id"]) for r in done.conflicts.collect()} == {("g2", "x"), ("g1", "q"), ("g9", "a"), ("g1", "z")}
    assert sorted(r["action"] for r in done.log.collect()) == ["SPLIT_CREATE", "SPLIT_REMOVE"]
    assert {r["changeType"] for r in done.events.collect()} == {"GOLDEN_RECORD_SPLIT", "GOLDEN_RECORD_CREATED_FROM_SPLIT"}


def test_the_last_member_stays(spark):
    _, golden, members = state(spark)
    asked = spark.createDataFrame([("g1", "z", 2), ("g1", "a", 1)], "golden_id string, source_record_id string, requested_at int")
    done = review.apply_splits(asked, golden, members)
    assert [(r["source_record_id"], r["problem"]) for r in done.conflicts.collect()] == [("z", "golden record has only one source record")]
    assert {r["source_record_id"] for r in done.members.filter("golden_id = 'g1'").collect()} == {"z"}


def test_lists(spark):
    candidates = state(spark)[0].withColumn("comparison_details", F.lit("x"))
    assert review.list_candidates(candidates, "PENDING").count() == 3 and "comparison_details" not in review.list_candidates(candidates).columns
    assert review.candidate_detail(candidates, "c2").first()["comparison_details"] == "x" and review.candidate_detail(candidates, "none").count() == 0
