import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm.mixing import mix, mixed, settle, source_targets, word_count

from .cases import SCHEMA, WORD, documents, frame


def expected_targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    rest, open_, out = sum(sizes.values()), list(names), {}
    while open_:
        share = {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = [n for n in open_ if share[n] > 3 * sizes[n]]
        if not over:
            return out | share
        for n in over:
            out[n] = 3 * sizes[n]
            open_.remove(n)
            rest -= out[n]
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, None: 1000}, {"a": 1, "b": 1, "c": 1}, {"é": 5, "Z": 50, "a": 0, "b": 7}, {None: 4}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = expected_targets(sizes)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_settling_keeps_words_and_chances():
    rng = np.random.default_rng(1)
    mass = np.sort(rng.integers(1, 500, 40))[::-1].astype(float)
    p = np.full(40, 0.3)
    sums, mean = [], np.zeros(40)
    for _ in range(3000):
        out = settle(p, mass, rng.random(40))
        assert ((out > 0) & (out < 1)).sum() <= 1
        sums.append((out * mass).sum())
        mean += out / 3000
    assert np.allclose(sums, (p * mass).sum()) and np.allclose(mean, 0.3, atol=0.05)


def test_mix(spark):
    rows = documents()
    df = frame(spark, rows).withColumnRenamed("lang", "size")
    got = mix(df).collect()
    assert sum(r.rows for r in got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    want = expected_targets(sizes)
    for source, target in want.items():
        own = [r for r in got if r.source == source]
        taken = sum(r.copies * r.size * r.rows for r in own)
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(target) and 0 <= r.copies <= 3 for r in own)
        assert abs(taken - target) <= max(r.size * r.rows for r in own)
    again = mix(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) if all(r.doc_id is not None for r in got) else {tuple(r) for r in got} == {tuple(r) for r in again}


def test_rows_are_repeated_as_often_as_taken(spark):
    rows = documents()
    df = frame(spark, rows)
    copies = {r.unit: r.copies * r.rows for r in mix(df).collect()}
    assert mixed(df).count() == sum(copies.values())
    assert mixed(df).columns == df.columns


def test_empty_table_and_word_count(spark):
    assert mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    got = spark.createDataFrame([(None,), ("",), (" a\tb\x0bc ",), ("é\xa0ß",)], "text string").select(word_count(F.col("text"))).collect()
    assert [r[0] for r in got] == [0, 0, 3, 1]
