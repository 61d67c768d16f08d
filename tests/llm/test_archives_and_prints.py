"""WARC round trips, I-Match, the permutation index and the whole pipeline."""

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import imatch, warc
from kinfold.llm.permutation_index import nearest
from kinfold.session import scratch_path

from .cases import documents, frame

PAGES = "page_id long, url string, html string, offset string"


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>same</p>", "x"), (2, "http://b/?q=\r\n%", "<p>same</p>", "x"), (3, None, None, "x"), (4, "u", "", "x"), (5, "u", "é\r\n\r\nWARC/1.1\r\n\r\n", "x"),
            (5, "u", "é\r\n\r\nWARC/1.1\r\n\r\n", "x"), (None, "n", "<p>same</p>", "x"), (None, "n", "alone", "x"), (9, "long", "z" * 500_000, "x"), (10, "long", "z" * 500_000, "x")]
    root = scratch_path(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), root)
    records = warc.read_records(index, root).collect()
    for r in records:
        html = [h for p, u, h, _ in rows if p == r.page_id and u == r.url and (r.payload is None or (h or "").encode() == r.payload)]
        assert html and (r.record_type == "revisit" or bytes(r.payload) == (html[0] or "").encode())
    resolved = warc.resolve_revisits(warc.read_records(index, root)).collect()
    for r in resolved:
        html = next((h or "").encode() for p, u, h, _ in rows if p == r.page_id and base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r.payload_digest)
        assert r.payload_bytes == len(html)
    kinds = {(r.page_id, r.payload_digest[:4]): (r.record_type, r.refers_to) for r in resolved}
    same = base64.b32encode(hashlib.sha1(b"<p>same</p>").digest()).decode()[:4]
    assert kinds[(2, same)] == ("revisit", 1) and kinds[(None, same)] == ("revisit", 1) and kinds[(1, same)] == ("response", None)
    assert len(resolved) == len(rows) and [r.refers_to for r in resolved if r.page_id in (4, 10)] in ([3, 9], [9, 3])
    few = warc.read_records(index.filter("page_id = 9"), root).collect()
    assert len(few) == 1 and few[0].payload_bytes == 500_000
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_edited_prints_against_plain_strings(spark):
    rows = [r for r in documents() if r[0] is not None]
    found = imatch.edited_prints(frame(spark, rows).withColumnRenamed("lang", "halo")).collect()
    texts = {}
    for r in rows:
        texts[r[0]] = min(texts.get(r[0], r[1] or ""), r[1] or "")
    order = sorted(texts)
    after = {a: texts[b] for a, b in zip(order, order[1:] + order[:1])}
    want = []
    for r in rows:
        text = r[1] or ""
        cut = len(text) // 4
        want.append((r[0], len(text), hashlib.sha256((text[: len(text) - cut] + after[r[0]][:cut]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == sorted(want)
    prints = {}
    assert all(prints.setdefault(t, r.fingerprint) == r.fingerprint for r in found for t in [texts[r.doc_id]])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    long = [r for r in found if r.n_chars > 100]
    assert np.mean([r.near_edited for r in long]) > 0.25


def test_edited_prints_of_few_rows_and_null_ids(spark):
    one = imatch.edited_prints(frame(spark, [(5, "abcdefgh", "en", "a", 1)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1
    two = {r.doc_id: r.edited_sha256 for r in imatch.edited_prints(frame(spark, [(5, "abcdefgh", "en", "a", 1), (None, "12345678", "en", "a", 1)])).collect()}
    assert two == {5: hashlib.sha256(b"abcdef12").hexdigest(), None: hashlib.sha256(b"123456ab").hexdigest()}
    assert imatch.edited_prints(frame(spark, [])).count() == 0


def test_ids_are_cut_by_rows_and_equal_ids_dealt(spark, monkeypatch):
    monkeypatch.setattr(imatch, "_BUCKET", 20)
    ids = [*range(200), 9 * 10**18, (1 << 63) - 1, -(1 << 63), *[77] * 150, *[None] * 170]
    rows = [(i, f"text {k % 90} of {i} and more words", "en", "a", 1) for k, i in enumerate(ids)]
    starts, salts = imatch._bounds(frame(spark, rows))
    assert len(starts) > 8 and salts[1 + starts.index(77)] > 4 and salts[-1] > 4
    low = {i: min(r[1] for r in rows if r[0] == i) for i in set(ids)}
    order = [*sorted(i for i in low if i is not None), None]
    after = {a: low[b] for a, b in zip(order, order[1:] + order[:1])}
    want = sorted((str(r[0]), hashlib.sha256((r[1][: len(r[1]) - len(r[1]) // 4] + after[r[0]][: len(r[1]) // 4]).encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.edited_sha256) for r in imatch.edited_prints(frame(spark, rows).repartition(5)).collect()) == want


def test_texts_without_the_lexicon_keep_their_likeness():
    rng = np.random.default_rng(4)
    known = [f"w{i}" for i in range(2000)]
    banded = np.sort(imatch._terms(pa.array([" ".join(known)]))[0])
    hot = [[f"hot{k}x{i}" for i in range(90)] for k in range(300)]
    following = [list(rng.choice(known, 22, replace=False)) for _ in hot]
    own = [list(rng.choice(known, 3, replace=False)) for _ in hot]
    of = lambda texts: imatch.prints(pa.array([" ".join(t) for t in texts]), banded)
    edited = of([h[:68] + f for h, f in zip(hot, following)])
    assert imatch.likeness(of(hot), edited).mean() > 0.25  # by all terms, against by 22 of 90 in the lexicon
    near = imatch.likeness(of([o + h for h, o in zip(hot, own)]), of([o + h[:67] + f for h, o, f in zip(hot, own, following)]))
    assert near.mean() > 0.25
    assert imatch.likeness(of(hot), np.roll(edited, 1, axis=0)).mean() < 0.05


def test_copies_count_once_in_the_lexicon(spark):
    texts = ["alpha beta"] * 30 + [f"beta word{i}" for i in range(30)]
    named = set(imatch.lexicon(frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts + ["alpha gamma"])])).tolist())
    assert int(imatch._terms(pa.array(["alpha"]))[0][0]) in named and int(imatch._terms(pa.array(["beta"]))[0][0]) not in named


def test_prints_by_hand():
    banded = np.sort(imatch._terms(pa.array(["alpha beta gamma"]))[0])
    a, b, c, blank = imatch.prints(pa.array(["alpha beta gamma zzz", "Gamma beta alpha beta", "alpha beta", " "]), banded)
    assert (a == b).all() and (a != c).any() and not blank.any()
    assert imatch.likeness(np.stack([a, a]), np.stack([b, blank])).tolist() == [1.0, 0.0]


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(400)]
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), rows[5], (402, None, 0), (403, [0.0] * 8, 0), (404, [float("nan")] * 8, 0), (405, [None] + [1.0] * 7, 0), (406, [1.0] * 3, 0), (None, rows[1][1], 0)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cid int")
    got = {}
    for r in nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and (i < 402 or i >= 1000)}
    assert set(got) == {i for i in usable if i % 100 == 0}
    hit = 0
    for q, answers in got.items():
        want = sorted((float(np.sqrt(((v - usable[q]) ** 2).sum())), i) for i, v in usable.items() if i != q)[:10]
        answers.sort()
        assert [a[0] for a in answers] == list(range(1, 11))
        assert all(s == pytest.approx(float(np.sqrt(((usable[i] - usable[q]) ** 2).sum())), abs=1e-9) for _, i, s in answers)
        hit += len({i for _, i, _ in answers} & {i for _, i in want})
    assert hit >= 0.9 * 10 * len(got)
    assert [i for _, i, _ in got[1000]] == [7, *range(1001, 1010)]
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    assert nearest(df.filter("vec_id = 3"), F.lit(True)).count() == 0


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
        if name in ("toxicity", "line_dedup", "near_dedup"):
            counts.append(kept.count())
            assert kept.join(docs, "doc_id", "left_anti").count() == 0
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    out = kept.collect()
    assert out and all(len(r.ids) == r.n_tokens for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mix_sources", "encode"]
