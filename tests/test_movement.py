import json

import pytest
from pyspark.sql import functions as F

from kinfold.plans.intake import intake
from kinfold.sinks import events, tables
from kinfold.sources import files, jdbc, messages
from kinfold.streaming import ingest
from kinfold.streaming.ingest import IntakePaths, drop_repeated, intake_batch, intake_stream
from kinfold.streaming.rollup import streaming_timeseries
from kinfold.operators.analytics import timeseries

FIELDS = ["id", "name", "email", "age", "country", "joined_at", "salary"]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,\"name\", city \n1,\"Smith, Ann\" , Oslo\n\n   \n2,'Bo'\n3,x,y,z\n4,,\"\"\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name", "city"]
    assert [tuple(r) for r in df.collect()] == [("1", "Smith, Ann", "Oslo"), ("2", "Bo", None), ("3", "x", "y"), ("4", None, None)]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "b": "x"}, {"id": 2, "c": true}]')
    (tmp_path / "b.json").write_text('{"id": 3}')
    (tmp_path / "bad.json").write_text("{nope")
    assert {tuple(r.asDict().items()) for r in files.read_json(spark, str(tmp_path / "a.json")).collect()} == {(("b", "x"), ("c", None), ("id", 1)), (("b", None), ("c", True), ("id", 2))}
    assert files.read_json(spark, str(tmp_path / "b.json")).first()["id"] == 3
    with pytest.raises(Exception):
        files.read_json(spark, str(tmp_path / "bad.json")).collect()


def test_file_check(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("x")
    (tmp_path / "noext").write_text("x")
    (tmp_path / "b.pdf").write_text("x")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.check_files(files.list_files(spark, str(tmp_path)), F.lit("t"), F.lit("c")).collect()}
    assert rows["a.CSV"]["accepted"] and rows["a.CSV"]["object_key"] == "t/raw/c/a.CSV" and rows["a.CSV"]["content_type"] == "text/csv"
    assert [rows[n]["accepted"] for n in ("noext", "b.pdf")] == [False, False]
    big = spark.createDataFrame([("x/a.csv", 600 * 1024 * 1024), ("x/b.csv", 60 * 1024 * 1024), ("x/empty.json", 0)], "path string, length bigint")
    assert [(r["accepted"], r["multipart"]) for r in files.check_files(big, F.lit("t"), F.lit("c")).collect()] == [(False, True), (True, True), (False, False)]


def test_jdbc_options():
    assert jdbc.extract_options("s.t") == {"dbtable": "s.t", "fetchsize": "1000"}
    assert jdbc.extract_options("s.t", "id", 1, 9, 4)["numPartitions"] == "4"
    assert jdbc.jdbc_url("postgresql", "h", 5432, "d") == "jdbc:postgresql://h:5432/d"
    with pytest.raises(ValueError):
        jdbc.extract_options("s.t", "id")


def test_discovery(spark):
    rows = [("public", "b", "BASE TABLE"), ("public", "a", "BASE TABLE"), ("crm", "Users", "BASE TABLE"), ("crm", "v", "VIEW"), ("pg_catalog", "x", "BASE TABLE")]
    catalog = spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")
    assert [tuple(r) for r in jdbc.discover_tables(catalog).collect()] == [("crm", "Users"), ("public", "a"), ("public", "b")]
    assert [tuple(r) for r in jdbc.discover_tables(jdbc.search_tables(catalog, "USER")).collect()] == [("crm", "Users")]
    columns = spark.createDataFrame([("s", "t", "b", 2), ("s", "t", "a", 1), ("s", "u", "z", 1)], "table_schema string, table_name string, column_name string, ordinal_position int")
    assert [r[0] for r in jdbc.discover_columns(columns, "s", "t").collect()] == ["a", "b"]


def test_decode_in_both_spellings(spark):
    values = [
        ("k", json.dumps({"eventId": "e", "tenantId": "t", "connectionId": "c", "totalRows": 1, "rows": [{"id": "1", "n": 2}]})),
        ("k", json.dumps({"tenant_id": "t", "source_id": "s", "row_count": 2, "batch_complete": True, "rows": []})), (None, "{}"), (None, None), ("k", "{oops"), ("k", "[1]"), ("k", "7"),
    ]
    decoded = messages.decode(spark.createDataFrame(values, "key string, value string").withColumn("offset", F.monotonically_increasing_id()), ["offset"])
    good = messages.good_messages(decoded).orderBy("offset").collect()
    assert [(r["tenant_id"], r["source_id"], r["row_count"], r["batch_complete"]) for r in good] == [
        ("t", "c", 1, False), ("t", "s", 2, True), ("unknown", "unknown", 0, False), ("unknown", "unknown", 0, False)]
    assert messages.dead_letters(decoded).count() == 3
    assert [tuple(r) for r in messages.explode_rows(decoded, ["id", "n", "x"]).select("id", "n", "x").collect()] == [("1", "2", None)]


def test_chunks_hold_at_most_their_size(spark):
    df = spark.range(2500).select(F.lit("t").alias("tenant_id"), F.lit("c").alias("connection_id"), F.lit("s").alias("source"), F.format_string("%05d", "id").alias("id"))
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    sizes = lambda size: sorted(json.loads(r["value"])["totalRows"] for r in messages.pack_rows(df, ["id"], at, size=size).collect())
    assert sizes(1000) == [500, 1000, 1000]
    assert sizes(10) == [10] * 250
    first = json.loads(messages.pack_rows(df, ["id"], at).filter("value LIKE '%00000%'").first()["value"])
    assert first["rows"][0] == {"id": "00000"} and first["ingestedAt"] == "2026-01-01T00:00:00Z"


@pytest.mark.parametrize("rows", [64_000, 64_001])
def test_chunks_follow_the_order_at_any_size(spark, rows):
    df = spark.range(rows).select(F.lit("t").alias("tenant_id"), F.lit("c").alias("connection_id"), F.lit("s").alias("source"), "id").repartition(13)
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    firsts = messages.pack_rows(df, ["id"], at, size=1000).select(F.get_json_object("value", "$.rows[0].id").cast("int").alias("i")).collect()
    assert sorted(r["i"] for r in firsts) == list(range(0, rows, 1000))


def test_staged_batches_are_replaced_not_repeated(spark, tmp_path):
    root = str(tmp_path / "staged")
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, name string")
    assert tables.write_staged(df, root, "t", "s", "b1") == 2
    assert tables.write_staged(df.limit(1), root, "t", "s", "b2") == 1
    assert tables.write_staged(df, root, "t", "s", "b1") == 2
    assert files.read_staged(spark, root).count() == 3 and files.read_staged(spark, root, batch_id="b2").count() == 1
    assert tables.write_staged(df.limit(0), root, "t", "s", "b3") == 0


def test_result_rows_and_events(spark):
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    review = spark.createDataFrame([("1", "2", 0.75)], "id_1 string, id_2 string, confidence_score double")
    row = tables.review_candidates(review, F.lit("t"), at).first()
    assert (row["record_id_a"], row["record_id_b"], row["status"]) == ("1", "2", "PENDING") and json.loads(row["payload"])["confidence_score"] == 0.75
    staged = tables.staging_records(spark.createDataFrame([(None, "x")], "id string, n string"), F.lit("t"), F.lit("s"), F.lit("b"), at).first()
    assert staged["raw_id"] == "" and json.loads(staged["data"]) == {"id": None, "n": "x"}
    golden = spark.createDataFrame([("gr-100", "acme", "c", 1, "Ann")], "golden_id string, tenant_id string, cluster_id string, cluster_size int, name string")
    sent = events.entity_resolved_events(golden, F.lit("Person")).first()
    assert sent["key"] == "acme:gr-100" and json.loads(sent["value"]) == {"tenant_id": "acme", "golden_id": "gr-100", "entity_type": "Person", "data": {"name": "Ann"}}
    batch = spark.createDataFrame([("acme", "s", "b")] * 3, "tenant_id string, source_id string, batch_id string")
    valid = events.ingest_valid_events(events.batch_summary(batch, "p", at), F.lit("Person")).first()
    assert valid["key"] == "acme:Person" and json.loads(valid["value"])["record_count"] == 3
    with pytest.raises(ValueError):
        events.publish(batch, "topic")


def envelopes(raw_batch, source="s"):
    rows = raw_batch.withColumns({"tenant_id": F.lit("t"), "connection_id": F.lit(source), "source": F.lit("f.csv")})
    return messages.pack_rows(rows, FIELDS, F.lit("2026-01-01 00:00:00").cast("timestamp"), size=4)


def signal(spark, source="s"):
    return spark.createDataFrame([("t", json.dumps({"tenant_id": "t", "source_id": source, "batch_complete": True}))], "key string, value string")


def test_stream_equals_batch(spark, raw_batch, tmp_path):
    topic = str(tmp_path / "topic")
    envelopes(raw_batch).unionByName(signal(spark)).unionByName(spark.createDataFrame([(None, "{bad")], "key string, value string")).write.parquet(topic)
    paths = IntakePaths(str(tmp_path / "intake"))
    query = intake_stream(spark.readStream.schema("key string, value string").parquet(topic), paths, FIELDS).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(r["id"] for r in spark.read.parquet(paths.staged).collect())
    assert got == sorted(r["id"] for r in intake(raw_batch).valid.collect())
    run = spark.read.parquet(paths.runs).first()
    assert (run["status"], run["records_input"], run["records_output"], run["records_failed"]) == ("COMPLETED", 12, 7, 3)
    assert spark.read.parquet(paths.dead).count() == 1


def test_replay_and_later_batches(spark, raw_batch, tmp_path):
    paths = IntakePaths(str(tmp_path / "intake"))
    handle = intake_batch(paths, FIELDS)
    half = raw_batch.filter("id <= 'm05'")
    handle(envelopes(half).unionByName(signal(spark)), 0)
    handle(envelopes(half).unionByName(signal(spark)), 0)
    assert spark.read.parquet(paths.raw).count() == 5 and spark.read.parquet(paths.runs).count() == 1
    handle(envelopes(raw_batch.filter("id > 'm05'")), 1)
    handle(signal(spark), 2)
    runs = {r["stream_batch"]: r["records_input"] for r in spark.read.parquet(paths.runs).collect()}
    assert runs == {0: 5, 2: 7}


def test_failed_run_goes_to_the_dead_letters(spark, raw_batch, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "WAIT_SECONDS", 0)
    paths = IntakePaths(str(tmp_path / "intake"))
    handle = intake_batch(paths, ["id", "email"])
    handle(envelopes(raw_batch).unionByName(signal(spark)), 0)  # no name: cleaning cannot run
    run = spark.read.parquet(paths.runs).first()
    assert (run["status"], run["records_input"], run["records_failed"]) == ("FAILED", 12, 12) and run["error_message"]
    lost = spark.read.parquet(paths.failed).collect()
    assert sorted(json.loads(r["raw_value"])["id"] for r in lost) == [f"m{i:02d}" for i in range(1, 13)]
    assert {r["reason"] for r in lost} == {run["error_message"]}
    handle(signal(spark), 1)
    assert spark.read.schema(ingest.STAGED_SCHEMA).parquet(paths.staged).count() == 0


def test_partial_failure_repeats_no_row(spark, raw_batch, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "WAIT_SECONDS", 0)
    paths = IntakePaths(str(tmp_path / "intake"))
    plain, broken = ingest.write_staged, [2]

    def failing(df, root, *rest):
        if root == paths.rejected and broken[0]:
            broken[0] -= 1
            raise OSError("no space")
        return plain(df, root, *rest)

    monkeypatch.setattr(ingest, "write_staged", failing)
    intake_batch(paths, FIELDS)(envelopes(raw_batch).unionByName(signal(spark)), 0)  # fails twice, then works
    once = sorted(r["id"] for r in spark.read.parquet(paths.staged).collect())
    assert once == sorted(r["id"] for r in intake(raw_batch).valid.collect()) and spark.read.parquet(paths.runs).first()["status"] == "COMPLETED"

    paths = IntakePaths(str(tmp_path / "second"))
    broken[0] = 99
    intake_batch(paths, FIELDS)(envelopes(raw_batch).unionByName(signal(spark)), 0)
    assert spark.read.parquet(paths.runs).first()["status"] == "FAILED" and spark.read.parquet(paths.failed).count() == 12
    assert spark.read.schema(ingest.STAGED_SCHEMA).parquet(paths.staged).count() == 0
    broken[0] = 0
    intake_batch(paths, FIELDS)(envelopes(raw_batch.filter("id IN ('m04', 'm05')")).unionByName(signal(spark)), 1)
    assert sorted(r["id"] for r in spark.read.parquet(paths.staged).collect()) == ["m04"]


def test_repeats_and_rollup(spark, tmp_path):
    rows = spark.range(200).select("id", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("ts"))
    path = str(tmp_path / "in")
    rows.unionByName(rows.filter("id % 2 = 0")).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    once = drop_repeated(stream, "ts", ["id"], "100 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == 200
    rolled = streaming_timeseries(stream, "ts", "1d", "count", None, "100 days").writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).start()
    rolled.awaitTermination()
    batch = timeseries(spark.read.parquet(path), "ts", "1d")
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, batch.collect()))
