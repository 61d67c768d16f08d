"""Toxicity, quality and language: exact sums against brute force, held-out accuracy, and odd rows."""

import ctypes
import itertools
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.llm import language as L
from kinfold.llm import quality as Q
from kinfold.llm import toxicity as X

from .cases import SCHEMA, sentence

FOLDER = "/root/testdata/sf0.01"


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    odds, first = rng.normal(size=12), np.array([0, 5, 5, 11, 12])
    start, moves = rng.normal(size=2), rng.normal(size=(2, 2))
    alpha, beta = X.forward_backward(odds, first, start, moves)
    got = (alpha * beta)[:, 1] / (alpha * beta).sum(axis=1)
    for a, b in zip(first[:-1], first[1:]):
        weights = {}
        for path in itertools.product((0, 1), repeat=b - a):
            if path:
                score = start[path[0]] + sum(moves[x, y] for x, y in zip(path, path[1:])) + sum(odds[a + k] for k, x in enumerate(path) if x)
                weights[path] = np.exp(score)
        for k in range(b - a):
            assert got[a + k] == pytest.approx(sum(w for p, w in weights.items() if p[k]) / sum(weights.values()))


def test_forward_backward_over_chunks():
    rng = np.random.default_rng(4)
    odds, start, moves = rng.normal(size=1500), rng.normal(size=2), rng.normal(size=(2, 2))
    one = X.forward_backward(odds, np.array([0, 1500]), start, moves)
    v = np.exp(start) * np.exp([0, odds[0]])
    for t in range(1500):
        v = v if t == 0 else (v / v.sum()) @ np.exp(moves) * np.exp([0, odds[t]])
        assert np.allclose(one[0][t], v / v.sum())


def toxic_rows():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 6 == 0
        words = sentence(rng, rng.randint(20, 60)).split(" ")
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["Vermin!", "vermin", "grubby" + rng.choice(["ab", "cd", "ef"])])
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_spans_and_odd_rows(spark):
    rows, labels = toxic_rows()
    extra = [(None, None, None, None, None), (900, "", "en", "a", 0), (901, "é vermin, " + "plain words here " * 3000, "en", "a", 1), rows[0]]
    docs = spark.createDataFrame(rows + extra, SCHEMA).withColumnRenamed("source", "score")
    model = X.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = docs.select("doc_id", "text", X.held_out(F.col("doc_id")).alias("h"), X.toxicity(spark, F.col("text"), model).alias("t")).collect()
    truth = {i: t for i, _, t in labels}
    assert all((r.t.score >= 0.5) == bool(truth[r.doc_id]) for r in found if r.doc_id in truth)
    for r in found:
        assert 0 <= r.t.score <= 1
        assert all(r.text[s.start:s.end].lower().startswith(("vermin", "grubby")) for s in r.t.spans)
    by_id = {r.doc_id: r for r in found}
    assert by_id[None].t.score == 0 and by_id[None].h and by_id[900].t.score == 0
    assert by_id[901].t.score >= 0.5 and [(s.start, s.end) for s in by_id[901].t.spans] == [(2, 8)]


def test_models_without_labels_or_rows(spark):
    docs, labels = spark.createDataFrame([(1, "a b c", "en", "a", 1)], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert docs.select(X.toxicity(spark, F.col("text"), X.train(docs, labels)).alias("t")).first().t.score < 0.5
    assert docs.select(Q.quality(spark, F.col("text"), Q.train(docs, labels)).alias("q")).first().q == 0.5
    empty = docs.limit(0)
    assert empty.select(X.toxicity(spark, F.col("text"), X.train(empty, labels))).count() == 0
    assert docs.select(L.language(spark, F.col("text"), L.train(empty)).alias("l")).first().l.lang == "und"


def test_quality_against_plain_neighbours(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels)
    scored = docs.select("doc_id", "text", X.held_out(F.col("doc_id")).alias("h"), Q.quality(spark, F.col("text"), model).alias("q")).collect()
    for r in scored[:60]:
        vector = Q._unit(Q._weighted(next(Q._blocks(pa.array([r.text]))), model.rarity) @ model.basis)[0]
        cosine = np.round(model.vectors @ vector, 6).astype(float)
        best = sorted(range(len(cosine)), key=lambda i: (-cosine[i], i))[: Q.NEIGHBOURS]
        weight = np.maximum(cosine[best], 0) ** 4
        assert r.q == pytest.approx((weight * model.labels[best]).sum() / weight.sum(), abs=0.02)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.q >= 0.3, truth[r.doc_id]) for r in scored if r.h and r.doc_id in truth]
    assert sum(p == bool(t) for p, t in held) / len(held) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "ab")], "doc_id long, text string").select(Q.quality(spark, F.col("text"), model).alias("q"))
    assert all(r.q == pytest.approx(model.mean) for r in odd.collect())


def test_partial_matching_is_a_probability():
    tree = L.grow(L._keys(*(lambda d: (d, np.array([0, len(d)])))(np.frombuffer(b"the cat sat on the mat, the end" * 9, np.uint8))))
    for context in (b"\0\0\0\0", b" the", b"zz t", b"qqqq", b"t, t"):
        keys = np.array([(int.from_bytes(context, "big") << 8) | b for b in range(256)], np.uint64)
        assert np.exp2(-L.code_lengths(tree, keys)).sum() == pytest.approx(1)


def test_code_lengths_by_hand_and_with_the_table():
    data = np.frombuffer(b"abab", np.uint8)
    tree = L.grow(L._keys(data, np.array([0, 4])))
    # "b" after "\0\0\0a" came once of one kind: 1 / (1 + 1)
    assert L.code_lengths(tree, np.array([(ord("a") << 8) | ord("b")], np.uint64))[0] == pytest.approx(1)
    model = L.Languages(["x"], [tree])
    texts = pa.array(["abab", "zzz", None, "ab" * 5000, ""])
    bits = model.text_bits(texts)[:, 0]
    again = model.text_bits(texts)[:, 0]
    offsets = T_offsets(texts)
    keys = L._keys(*offsets)
    each = L.code_lengths(tree, keys)
    want = [each[a:b].sum() for a, b in zip(offsets[1][:-1], offsets[1][1:])]
    assert np.allclose(bits, want, rtol=1e-5) and np.allclose(again, want, rtol=1e-5)


def T_offsets(texts):
    from kinfold.llm import tokens as T

    return T.buffers(texts)


def test_language_accuracy_and_und(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = L.train(docs)
    scored = docs.select("lang", X.held_out(F.col("doc_id")).alias("h"), L.language(spark, F.col("text"), model).alias("l")).filter("h").collect()
    assert sum(r.lang == r.l.lang for r in scored) / len(scored) > 0.95
    odd = spark.createDataFrame([(None,), ("",), ("12 34 !",)], "text string").select(L.language(spark, F.col("text"), model).alias("l")).collect()
    assert all(r.l.lang == "und" and r.l.score == 0 for r in odd)


def test_a_language_with_long_texts_only_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_CHARS", 300)
    monkeypatch.setattr(L, "SAMPLE_DOCS", 6)
    rows = [(i, "aa", "the cat and the dog sat there " * (2 if i % 2 else 20), "x") for i in range(40)] + [(None, "aa", None, "x"), (3, None, "the", "x")]
    rows += [(100 + i, "bb", "der hund und die katze schlafen " * 30, "x") for i in range(40)] + [(900, "cc", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, place string")
    model = L.train(docs)
    assert sorted(model.names) == ["aa", "bb"]
    guess = spark.createDataFrame([("the dog and the cat",), ("und der hund schlafen",)], "text string").select(L.language(spark, F.col("text"), model).alias("l")).collect()
    assert [r.l.lang for r in guess] == ["aa", "bb"]


def test_training_leaves_no_freed_arrays_with_the_driver(spark, monkeypatch):
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("the C library hands memory back by itself")
    held = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    kept = []

    def fit(texts, toxic):
        arrays = [np.ones(100_000, np.int8) for _ in range(2000)]  # 200 MB in blocks that the C library keeps
        kept.append(arrays[-1])
        return X.Field()

    monkeypatch.setattr(X, "fit", fit)
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    before = held()
    X.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert held() - before < 100
