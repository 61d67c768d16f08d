import random
import statistics
from datetime import datetime, timedelta, timezone

import pytest

from kinfold.operators.anomaly import MEAN_SCALE, MEDIAN_SCALE, anomalies, series_points

START = datetime(2024, 3, 4, tzinfo=timezone.utc)
SCHEMA = "series string, ts timestamp, value double, timestamp string"


def _spiked():
    """Thirty days of hourly values that swing by the hour, with a night value that the whole range would not notice."""
    rng = random.Random(3)
    rows = [["s", START + timedelta(hours=h), 100.0 * (h % 24) + rng.randint(0, 9), "clash"] for h in range(24 * 30)]
    rows[24 * 20 + 2][2] = 1500.0
    return rows


def _plain(values, step, history):
    """Verdicts for points ``[(place in time, value)]`` at every ``step``-th place."""
    at, out = dict(values), {}
    for i, value in values:
        seen = [at[j] for j in range(i - history * step, i, step) if j in at]
        middle = statistics.median(seen) if seen else None
        off = [abs(x - middle) for x in seen]
        spread = (statistics.median(off) * MEDIAN_SCALE or statistics.mean(off) * MEAN_SCALE) if off else 0
        far = seen and (abs(value - middle) / spread > 3.5 if spread else value != middle)
        out[i] = (len(seen), middle, bool(far and len(seen) >= 5))
    return out


def test_a_spike_inside_the_range_is_found(spark):
    rows = _spiked()
    found = anomalies(spark.createDataFrame(rows, SCHEMA), "ts", "1h", "sum:value", ["series"], "1d", 14).collect()
    wanted = _plain([(h, r[2]) for h, r in enumerate(rows)], 24, 14)
    got = {int((r.timestamp.timestamp() - START.timestamp()) // 3600): (r.n_before, r.expected, r.is_anomaly) for r in found}
    assert got == wanted and got[24 * 20 + 2][2]
    assert rows[24 * 20 + 2][2] < max(r[2] for r in rows)


def test_steady_series_gaps_and_blanks(spark):
    rows = [("a", START + timedelta(days=d), 1.0 if d < 9 else 2.0, "") for d in range(10)]
    rows += [("b", START + timedelta(days=d), None, "") for d in range(8)] + [("c", None, 5.0, ""), (None, START, 1.0, ""), (None, START, 2.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.series, r.timestamp): r for r in anomalies(df, "ts", "1d", "sum:value", ["series"]).collect()}
    assert {k[0] for k in found} == {"a", None} and len(found) == 11
    assert [k[1].day for k, r in found.items() if r.is_anomaly] == [13]
    assert all(r.deviation is None for r in found.values())
    assert anomalies(df.limit(0), "ts", "1d", "count", ["series"]).isEmpty()
    with pytest.raises(ValueError):
        anomalies(df, "ts", "7h")


def test_absent_intervals_can_count_as_a_value(spark):
    rows = [("a", START + timedelta(days=d), 1.0, "") for d in range(12) if d != 8]
    df = spark.createDataFrame(rows, SCHEMA)
    assert series_points(df, "ts", "1d", "count", ["series"]).count() == 11
    found = anomalies(df, "ts", "1d", "count", ["series"], absent=0.0).filter("is_anomaly").collect()
    assert [(r.timestamp.day, r.value) for r in found] == [(12, 0.0)]
