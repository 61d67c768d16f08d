import datetime
import math
import random

import pytest

from kinfold.operators import rollups

SCHEMA = "kind string, at timestamp, v double, n int"


def plain(values, q):
    return sorted(values)[max(1, math.ceil(len(values) * q)) - 1]


def test_merged_rollups_agree_with_the_values(spark):
    random.seed(12)
    start = datetime.datetime(2024, 3, 4)
    rows = [(random.choice("ab"), start + datetime.timedelta(minutes=random.randrange(3 * 1440)), random.choice([0.0, -1.0, 1.0, 1.0]) * random.lognormvariate(2, 2), 1) for _ in range(3000)]
    odd = [("a", None, 1.0, 1), ("a", start, None, 1), ("b", start, math.nan, 1), ("b", start, math.inf, 1), (None, start, 7.5, 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    stored = rollups.rollup(df, "at", "1h", "v", ["kind"])
    got = {(r.kind, r.timestamp): r for r in rollups.summary(rollups.merged(stored, "1d", ["kind"]), (0.05, 0.5, 0.95), ["kind"]).collect()}
    wanted = {}
    for kind, at, v, _ in rows + [odd[-1]]:
        wanted.setdefault((kind, datetime.datetime(at.year, at.month, at.day)), []).append(v)
    assert set(got) == set(wanted)
    for key, values in wanted.items():
        r, mean = got[key], sum(values) / len(values)
        assert (r.n, r.least, r.most) == (len(values), min(values), max(values)) and r["mean"] == pytest.approx(mean)
        assert r.stddev is None if len(values) == 1 else r.stddev == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in values) / (len(values) - 1)))
        for q, name in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95")):
            exact = plain(values, q)
            assert abs(r[name] - exact) <= rollups.ERROR * abs(exact) * 1.0001
    halves = rollups.rollup(df.filter("v < 1"), "at", "1h", "v").unionByName(rollups.rollup(df.filter("v >= 1"), "at", "1h", "v"))
    assert rollups.summary(rollups.merged(halves, "1w")).first().n == len(rows) + 1
    assert rollups.summary(rollups.rollup(df.limit(0), "at", "1h", "v")).count() == 0
