"""Are the rows of a finished batch all there? Keyed state with timers over the message stream."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.messages import good_messages

COMPLETE, SHORT, UNSTATED = "COMPLETE", "SHORT", "UNSTATED"
REPORT = "tenant_id string, source_id string, expected bigint, received bigint, missing bigint, status string"
_STATE = "received bigint, pending string"
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _millis(text: str) -> int:
    found = re.fullmatch(r"([1-9]\d*) (second|minute|hour|day)s?", text)
    if not found:
        raise ValueError(f"cannot read duration {text!r}")
    return int(found[1]) * _UNITS[found[2]] * 1000


def _settled(received: int, pending: list[list[int]]) -> tuple[int, list[tuple[int, int, str]]]:
    """Take the batches off the front of ``pending`` that can be settled; what is left of ``received``, and the verdicts."""
    done = []
    while pending and (pending[0][0] <= 0 or received >= pending[0][0]):
        expected = pending.pop(0)[0]
        if expected <= 0:
            done.append((0, received, UNSTATED))
            received = 0
        else:
            done.append((expected, expected, COMPLETE))
            received -= expected
    return received, done


def _watch(wait: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        received, pending = (state.get[0], json.loads(state.get[1])) if state.exists else (0, [])
        now, done = state.getCurrentWatermarkMs(), []
        if state.hasTimedOut:
            while pending and pending[0][1] <= now:
                done.append((pending.pop(0)[0], received, SHORT))
                received = 0
        else:
            signals = []
            for frame in frames:
                received += int(frame["n_rows"].sum())
                told = frame[frame["expected"].notna()]
                signals += zip(told["millis"].astype("int64").tolist(), told["expected"].astype("int64").tolist())
            pending += [[expected, max(at, now) + wait] for at, expected in sorted(signals)]
        received, settled = _settled(received, pending)
        done += settled
        if pending or received:
            state.update((received, json.dumps(pending)))
            if pending:
                state.setTimeoutTimestamp(max(min(due for _, due in pending), now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, e, r, e - r if s == SHORT else 0, s) for e, r, s in done], columns=["tenant_id", "source_id", "expected", "received", "missing", "status"])

    return run


def batch_completeness(decoded: DataFrame, time_column: str, wait: str = "10 minutes", delay: str | None = "10 minutes") -> DataFrame:
    """``(tenant_id, source_id, expected, received, missing, status)``: one row for each batch-complete signal.

    The rows of a source's messages, those of the signal among them, are counted against the ``row_count`` the signal
    states. ``COMPLETE`` comes as soon as the rows are there, in whichever order rows and signal arrive; ``SHORT`` when the
    watermark has passed the signal by ``wait``, with the rows that were received by then and are missing. A signal without
    a count is ``UNSTATED`` and takes all rows so far. Signals of a source are settled in the order of their times; rows
    beyond the count of a batch belong to the next one, for messages do not name their batch.

    ``decoded`` comes from ``decode`` with ``time_column`` among its kept columns. Messages that cannot be read count
    nothing. Repeated messages are to be dropped before (``drop_repeated``); then ``delay`` is None, as the stream has its
    watermark already. Only two numbers and a time of each message reach the state, which holds one number and the open
    signals of a source, whatever the number of rows.
    """
    few = good_messages(decoded).select(
        "tenant_id", "source_id", F.col(time_column), F.unix_millis(F.col(time_column)).alias("millis"),
        F.coalesce(F.size("rows"), F.lit(0)).cast("bigint").alias("n_rows"), F.when(F.col("batch_complete"), F.col("row_count")).alias("expected"),
    )
    few = few.filter("n_rows > 0 OR expected IS NOT NULL")
    if delay is not None:
        few = few.withWatermark(time_column, delay)
    return few.groupBy("tenant_id", "source_id").applyInPandasWithState(_watch(_millis(wait)), REPORT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
