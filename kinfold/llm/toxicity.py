"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Labels exist for documents only, so training tokens are labelled from them: in toxic documents, a token one of whose
features (the word, its first four, five or six bytes) is bound to toxic documents by a log-likelihood ratio counts as
toxic, all others as clean. The field has one weight for every feature that tells the two kinds of document apart, and a
transition matrix, fitted by gradient steps on the exact likelihood of one batch of documents after another. Scoring runs forward-backward over every token of a text; tokens with a marginal of at
least one half are the offending offsets, and the document's score is the chance that any of them is toxic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens as T

#: The most documents of each label one model learns from, the longest of them and all of a label in characters.
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 20_000
SAMPLE_TOTAL = 4_000_000
_BATCH = 1 << 19
_PREFIXES = (4, 5, 6)
_RATIO = 24.0
_TELLING = 8.0
_ROUNDS = 8
_CHUNK = 128
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
_RESULT = pa.struct([("score", pa.float64()), ("spans", pa.list_(_SPAN))])


@dataclass
class Field:
    """Sorted feature hashes and their weights, bias of a toxic token, start and transition scores (from row to column)."""

    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    bias: float = -8.0
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document of tokens, first token of documents, the bytes, and feature hashes (tokens x features)."""
    data, offsets = T.buffers(texts)
    data = T.lower(data)
    keep = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    start, end, doc, first = T.spans(keep, offsets)
    hashes = T.SpanHash(data)
    columns = [hashes(start, end)]
    for k, n in enumerate(_PREFIXES):
        columns.append(T.mix(hashes(start, np.minimum(start + n, end)) ^ np.uint64((k + 1) * 0x51ED270B)))
    return start, end, doc, first, data, np.stack(columns, axis=1)


def _slots(names: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Position of each feature among ``names``, or one past the last for a feature that is not there."""
    at = np.searchsorted(names, features)
    found = names[np.minimum(at, len(names) - 1)] == features if len(names) else np.zeros(features.shape, bool)
    return np.where(found, at, len(names))


def forward_backward(odds: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward and backward messages (tokens x 2) of all chains of a batch.

    ``odds`` is the score of state 1 over state 0 by token, ``first`` where the chains begin. The tokens are laid out in
    chunks that advance together; the products of each chunk's matrices carry the messages exactly from chunk to chunk.
    A chain's first matrix has equal rows, which makes what comes before it irrelevant.
    """
    n = len(odds)
    chunks = -(-n // _CHUNK)
    gain = np.zeros(chunks * _CHUNK)
    gain[:n] = np.clip(odds, -60, 60)
    head = np.zeros(chunks * _CHUNK, bool)
    head[first[:-1][np.diff(first) > 0]] = True
    head[n:] = True  # what fills the last chunk belongs to no chain
    top = np.maximum(gain, 0)
    e = np.stack([np.exp(-top), np.exp(gain - top)], axis=-1).reshape(chunks, _CHUNK, 2)
    head = head.reshape(chunks, _CHUNK)
    t, s = np.exp(moves - moves.max()), np.exp(start - start.max())

    def matrix(k):
        m = np.where(head[:, k, None, None], s[None, None, :], t[None, :, :])
        return m * e[:, k, None, :]

    product = np.broadcast_to(np.eye(2), (chunks, 2, 2)).copy()
    for k in range(_CHUNK):
        m = matrix(k)
        product = product[:, :, :1] * m[:, :1, :] + product[:, :, 1:] * m[:, 1:, :]
        product /= product.max(axis=(1, 2), keepdims=True)
    into, out = np.full((chunks, 2), 0.5), np.full((chunks, 2), 0.5)
    for c in range(1, chunks):
        v = into[c - 1] @ product[c - 1]
        into[c] = v / v.sum()
    for c in range(chunks - 2, -1, -1):
        v = product[c + 1] @ out[c + 1]
        out[c] = v / v.sum()
    alpha, beta = np.empty((chunks, _CHUNK, 2)), np.empty((chunks, _CHUNK, 2))
    now = into
    for k in range(_CHUNK):
        m = matrix(k)
        now = now[:, :1] * m[:, 0] + now[:, 1:] * m[:, 1]
        now = now / now.sum(axis=1, keepdims=True)
        alpha[:, k] = now
    now = out
    for k in reversed(range(_CHUNK)):
        beta[:, k] = now
        m = matrix(k)
        now = m[:, :, 0] * now[:, :1] + m[:, :, 1] * now[:, 1:]
        now = now / now.sum(axis=1, keepdims=True)
    return alpha.reshape(-1, 2)[:n], beta.reshape(-1, 2)[:n]


def marginals(model: Field, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The chance of each token to be toxic."""
    if not len(features):
        return np.zeros(0)
    odds = model.weights[_slots(model.names, features)].sum(axis=1) + model.bias
    alpha, beta = forward_backward(odds, first, model.start, model.moves)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1)


def _bound_to_toxic(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens have a feature that toxic documents hold far more often than their share, and all telling features."""
    n, t = len(toxic), int(toxic.sum())
    share = t / n
    bound, telling = np.zeros(len(doc), bool), []
    for k in range(features.shape[1]):
        names = np.unique(features[:, k])
        where = np.searchsorted(names, features[:, k]).astype(np.int32)
        pairs = np.unique(where * np.int64(n) + doc)
        name, holder = pairs // n, pairs % n
        all_docs = np.bincount(name, minlength=len(names))
        toxic_docs = np.bincount(name, weights=toxic[holder], minlength=len(names))
        clean_docs = all_docs - toxic_docs
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(toxic_docs > 0, toxic_docs * np.log(toxic_docs / (all_docs * share)), 0)
                         + np.where(clean_docs > 0, clean_docs * np.log(clean_docs / (all_docs * (1 - share))), 0))
        marked = (ratio > _RATIO) & (toxic_docs >= 10 * clean_docs * share / (1 - share)) & (toxic_docs > 4 * clean_docs)
        bound |= marked[where]
        telling.append(names[(ratio > _TELLING) & (toxic_docs > 0)])
    return bound, np.unique(np.concatenate(telling))


def without_copies(words: np.ndarray, first: np.ndarray, size: int = 3, marks: int = 8) -> np.ndarray:
    """Marks the documents that share none of their few least ``size``-word hashes with an earlier one.

    A training sample with copies would make the words of one copied text look typical of its label.
    """
    runs, begin = T.shingles(T.Words(first, first, first, words, first), size)
    fresh, seen = np.ones(len(first) - 1, bool), set()
    for i in range(len(fresh)):
        least = set(np.sort(runs[begin[i]: begin[i + 1]])[:marks].tolist())
        fresh[i] = seen.isdisjoint(least)
        seen |= least
    return fresh


def fit(texts: pa.Array, toxic: np.ndarray) -> Field:
    """A field learnt from labelled documents; one that marks nothing where either label is missing.

    Hashes are made a batch at a time and replaced by 32-bit places among the telling features, so memory holds four
    numbers a token and the messages of one batch.
    """
    model, parts, sizes = Field(), [], []
    for a, b in T._cuts(texts, _BATCH):
        _, _, _, first, _, hashed = _tokens(texts.slice(a, b - a))
        parts.append(hashed)
        sizes.append(np.diff(first))
    if not parts:
        return model
    features, sizes = np.concatenate(parts), np.concatenate(sizes)
    parts.clear()
    fresh = without_copies(features[:, 0], np.concatenate(([0], np.cumsum(sizes))))
    toxic = toxic[fresh]
    if not toxic.any() or toxic.all():
        return model
    features, sizes = features[np.repeat(fresh, sizes)], sizes[fresh]
    doc = np.repeat(np.arange(len(toxic), dtype=np.int32), sizes)
    bound, model.names = _bound_to_toxic(features, doc, toxic)
    model.weights = np.zeros(len(model.names) + 1)
    label = (bound & toxic[doc]).astype(np.int8)
    if not label.any():
        return model
    where = np.concatenate([_slots(model.names, features[a: a + _BATCH]).astype(np.int32) for a in range(0, len(features), _BATCH)])
    del features
    _climb(model, where, label, np.concatenate(([0], np.cumsum(sizes))))
    return model


def _climb(model: Field, where: np.ndarray, label: np.ndarray, first: np.ndarray) -> None:
    """Gradient steps on the likelihood of ``label``, over batches of whole documents."""
    cuts = np.unique(np.searchsorted(first, np.arange(0, first[-1], _BATCH // 4)).tolist() + [len(first) - 1])
    total = np.zeros(len(model.weights))
    scale = {"bias": 0.0, "start": np.zeros(2), "moves": np.zeros((2, 2))}
    for _ in range(_ROUNDS):
        for a, b in zip(cuts[:-1], cuts[1:]):
            if first[a] == first[b]:
                continue
            at, truth, begin = where[first[a]: first[b]], label[first[a]: first[b]], first[a: b + 1] - first[a]
            steps = _gradient(model, at, truth, begin)
            total += steps["weights"] ** 2
            model.weights += 0.8 * steps.pop("weights") / np.sqrt(total + 1e-6)
            for name, step in steps.items():
                scale[name] = scale[name] + step * step
                setattr(model, name, getattr(model, name) + 0.3 * step / np.sqrt(scale[name] + 1e-6))


def _gradient(model: Field, where: np.ndarray, label: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """What the labels of a batch hold beyond what the model expects, for each of its parameters."""
    head = np.zeros(len(label), bool)
    head[first[:-1][np.diff(first) > 0]] = True
    inner = np.flatnonzero(~head)
    odds = model.weights[where].sum(axis=1) + model.bias
    alpha, beta = forward_backward(odds, first, model.start, model.moves)
    both = alpha * beta
    off = label - both[:, 1] / both.sum(axis=1)
    weights = sum(np.bincount(where[:, k], off, minlength=len(model.weights)) for k in range(where.shape[1])) - 1e-3 * model.weights
    weights[-1] = 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner - 1], label[inner]), 1)
    gain = np.stack([np.ones(len(inner)), np.exp(np.clip(odds[inner], -60, 60))], 1)
    edge = alpha[inner - 1][:, :, None] * np.exp(model.moves)[None] * (gain * beta[inner])[:, None, :]
    start = np.bincount(label[head], minlength=2) - (both[head] / both[head].sum(axis=1, keepdims=True)).sum(axis=0)
    return {"weights": weights, "bias": off.sum(), "start": start, "moves": seen - (edge / edge.sum(axis=(1, 2), keepdims=True)).sum(axis=0)}


def scorer(model: Field):
    """An Arrow function from texts to scores and offending spans (character offsets)."""

    def piece(texts: pa.Array) -> pa.Array:
        start, end, doc, first, data, features = _tokens(texts)
        p = marginals(model, features, first)
        n = len(texts)
        hit = np.flatnonzero(p >= 0.5)
        most = T.fold(np.maximum, p, first, 0.0)
        clear = np.zeros(n)
        np.add.at(clear, doc[hit], np.log1p(-np.minimum(p[hit], 1 - 1e-12)))
        score = np.where(np.bincount(doc[hit], minlength=n) > 0, -np.expm1(clear), most)
        _, offsets = T.buffers(texts)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        base = chars[offsets[doc[hit]]]
        spans = pa.StructArray.from_arrays(
            [pa.array((chars[start[hit]] - base).astype(np.int32)), pa.array((chars[end[hit]] - base).astype(np.int32)), pa.array(p[hit])], fields=list(_SPAN))
        bounds = np.concatenate(([0], np.cumsum(np.bincount(doc[hit], minlength=n)))).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(score), pa.ListArray.from_arrays(pa.array(bounds), spans)], fields=list(_RESULT))

    return piece


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept for testing; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int, chars: int) -> tuple[pa.Array, np.ndarray]:
    """At most ``size`` texts of at most ``chars`` characters with their labels, the same in every run.

    Documents are chosen by the hash of their id among those with a label that are not held out. An id with several
    labels counts with the largest, an id with several texts with the smallest.
    """
    known = labels.filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    found = docs.select("doc_id", "text").filter(F.length("text") <= chars).join(F.broadcast(known), "doc_id")
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").alias("label")).toArrow()
    found = found.sort_by("doc_id").combine_chunks()
    text = found.column("text").combine_chunks() if found.num_rows else pa.array([], pa.string())
    return text, found.column("label").to_numpy().astype(bool) if found.num_rows else np.zeros(0, bool)


def balanced_sample(docs: DataFrame, labels: DataFrame, label: str, size: int, chars: int, total: int) -> tuple[pa.Array, np.ndarray]:
    """At most ``size`` texts of each label, none of more than ``chars`` characters nor all of a label of more than
    ``total``, with their labels in an order that mixes them: the same in every run.

    Only documents that are there, labelled, not held out and short enough take places, by the hash of their id. An id
    with several labels counts with the largest, an id with several texts with the smallest.
    """
    known = labels.filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("_label"))
    there = docs.select("doc_id", F.length("text").alias("_chars")).filter(F.col("_chars") <= chars).groupBy("doc_id").agg(F.max("_chars").alias("_chars"))
    order = Window.partitionBy("_label").orderBy(F.xxhash64("doc_id"), "doc_id")
    first = known.join(there, "doc_id").withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= size)
    chosen = first.withColumn("_upto", F.sum("_chars").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_upto") <= total)
    chosen = chosen.select("doc_id", "_label", "_place")  # two numbers for each of at most two times ``size`` documents
    found = docs.select("doc_id", "text").filter(F.length("text") <= chars).join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("doc_id", "_place").agg(F.min("text").alias("text"), F.max("_label").alias("label")).toArrow()
    found = found.sort_by([("_place", "ascending"), ("label", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    text = found.column("text").combine_chunks() if found.num_rows else pa.array([], pa.string())
    return text, found.column("label").to_numpy().astype(bool) if found.num_rows else np.zeros(0, bool)


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """The field fitted on a bounded sample of labelled documents of either label.

    Ties in the order of hashes go to the smaller id. Other columns of ``docs`` and ``labels`` are ignored.
    """
    model = fit(*balanced_sample(docs, labels, "toxic", SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL))
    T.give_back_arrays()  # else the driver stays as large as while it learnt
    return model


def toxicity(spark: SparkSession, text: Column, model: Field) -> Column:
    """``struct(score, spans)`` of a text column; null and empty texts score 0 without spans."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score: double, spans: array<struct<start: int, end: int, p: double>>>")
    def score(texts: pa.Array) -> pa.Array:
        return T.by_slices(texts, scorer(shared.value), _RESULT)

    return score(text)
