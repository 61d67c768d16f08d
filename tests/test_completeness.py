import json
import os

from kinfold.sources.messages import decode
from kinfold.streaming.completeness import batch_completeness
from kinfold.streaming.ingest import drop_repeated


def _message(source, minute, rows=0, count=None, event=None):
    value = {"tenant_id": "t", "source_id": source, "rows": [{"id": str(i)} for i in range(rows)], "eventId": event or f"{source}-{minute}"}
    if count is not None:
        value |= {"row_count": count, "batch_complete": True}
    return {"key": "t", "value": json.dumps(value), "at": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"}


def _run(spark, folder, name, steps, repeats=False):
    """The reports of a stream that receives one file a micro-batch."""
    os.makedirs(folder / name)
    for i, step in enumerate(steps):
        path = folder / name / f"{i}.json"
        path.write_text("".join(json.dumps(m) + "\n" for m in step))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("key string, value string, at timestamp").option("maxFilesPerTrigger", 1).json(str(folder / name))
    decoded = decode(stream, ["at"])
    if repeats:
        found = batch_completeness(drop_repeated(decoded, "at", ["event_id"], "1 minute"), "at", "5 minutes", None)
    else:
        found = batch_completeness(decoded, "at", "5 minutes", "1 minute")
    query = found.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r)[1:] for r in spark.table(name).collect())


def test_rows_before_and_after_the_signal_and_missing_ones(spark, tmp_path):
    steps = [
        [_message("early", 1, 3), _message("signal_first", 1, 1, 4), _message("short", 1, 2), _message("unsaid", 1, 2), {"key": "t", "value": "{cut", "at": "2024-01-01T00:01:00Z"}],
        [_message("early", 2, 0, 3), _message("signal_first", 2, 3), _message("short", 2, 0, 5), _message("unsaid", 2, 0, 0), _message("open", 2, 7)],
        [_message("clock", 60, 1)],
    ]
    assert _run(spark, tmp_path, "completeness", steps) == [
        ("early", 3, 3, 0, "COMPLETE"), ("short", 5, 2, 3, "SHORT"), ("signal_first", 4, 4, 0, "COMPLETE"), ("unsaid", 0, 2, 0, "UNSTATED"),
    ]


def test_batches_of_a_source_are_settled_in_order(spark, tmp_path):
    steps = [[_message("s", 3, 0, 2), _message("s", 1, 0, 4)], [_message("s", 2, 4)], [_message("s", 4, 2)]]
    assert _run(spark, tmp_path, "in_order", steps) == [("s", 2, 2, 0, "COMPLETE"), ("s", 4, 4, 0, "COMPLETE")]


def test_repeated_messages_count_once(spark, tmp_path):
    steps = [[_message("s", 1, 2, event="x"), _message("s", 1, 2, event="x")], [_message("s", 1, 2, event="x"), _message("s", 2, 0, 4)], [_message("clock", 60, 1)]]
    assert _run(spark, tmp_path, "repeats", steps, True) == [("s", 4, 2, 2, "SHORT")]
