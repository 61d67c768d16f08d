"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A text is a vector of hashed byte trigrams and a term for words that repeat the word before them, dampened, weighted by
rarity in the sample and scaled to length one; the leading right singular vectors of the labelled sample take it to a few dimensions. The labelled vectors are few by a
stated bound and are broadcast. Every document meets all of them in blocked exact cosine products, and the nearest
vote with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .toxicity import labelled_sample, without_copies

#: The most labelled documents a model holds and the longest of them in characters; both bound what is broadcast.
SAMPLE_DOCS = 4000
SAMPLE_CHARS = 20_000
NEIGHBOURS = 15
_SLOTS = 2048
_RANK = 48
_BLOCK = 512
_REPEATS = 4.0


@dataclass
class Voters:
    """Rarity by trigram slot, projection, unit vectors of the labelled documents, their labels, and the mean label."""

    rarity: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    mean: float


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts by slot of each document (documents x slots); slot 0 counts words equal to the word before."""
    docs = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((docs, _SLOTS), np.float32)
    with np.errstate(over="ignore"):
        wide = data.astype(np.uint32)
        key = ((wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]) * np.uint32(0x9E3779B1)
        slot = (key >> np.uint32(21)).astype(np.int64)
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    inside = owner[:-2] == owner[2:]
    found = np.bincount((owner[:-2] * _SLOTS + slot)[inside], minlength=docs * _SLOTS).reshape(docs, _SLOTS).astype(np.float32)
    terms = T.words(data, offsets)
    again = (terms.hash[1:] == terms.hash[:-1]) & (terms.doc[1:] == terms.doc[:-1])
    found[:, 0] = np.bincount(terms.doc[1:][again], minlength=docs)
    return found


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 1e-12)


def _weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts) * rarity
    rows[:, 0] *= _REPEATS
    return _unit(rows)


def _blocks(texts: pa.Array):
    data, offsets = T.buffers(texts)
    for a in range(0, len(texts), _BLOCK):
        b = min(a + _BLOCK, len(texts))
        yield _counts(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])


def fit(texts: pa.Array, labels: np.ndarray) -> Voters:
    """Voters from labelled texts; copies among them count once."""
    if len(texts):
        data, offsets = T.buffers(texts)
        found = T.words(T.lower(data), offsets)
        fresh = without_copies(found.hash, found.first)
        texts, labels = texts.filter(pa.array(fresh)), labels[fresh]
    mean = float(labels.mean()) if len(labels) else 0.5
    counts = np.concatenate(list(_blocks(texts))) if len(texts) else np.zeros((0, _SLOTS), np.float32)
    rarity = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 0.1
    rows = _weighted(counts, rarity)
    rank = min(_RANK, *rows.shape)
    if rank == 0:
        return Voters(rarity, np.zeros((_SLOTS, 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float32), mean)
    range_ = np.random.default_rng(7).standard_normal((_SLOTS, min(rank + 16, _SLOTS))).astype(np.float32)
    for _ in range(4):
        range_ = np.linalg.qr(rows.T @ (rows @ range_))[0]
    small = np.linalg.svd(rows @ range_, full_matrices=False)
    basis = (range_ @ small[2].T[:, :rank]).astype(np.float32)
    return Voters(rarity, basis, _unit(rows @ basis), labels.astype(np.float32), mean)


def votes(model: Voters, texts: pa.Array) -> np.ndarray:
    """Weighted mean label of the nearest voters; the mean of the sample for a text without trigrams."""
    out = []
    k = min(NEIGHBOURS, len(model.labels))
    for counts in _blocks(texts):
        vectors = _unit(_weighted(counts, model.rarity) @ model.basis)
        if k == 0:
            out.append(np.full(len(vectors), model.mean))
            continue
        near = np.round(vectors @ model.vectors.T, 6).astype(np.float64)
        # ties to the earlier voter
        ranked = near - np.arange(len(model.labels)) * 1e-11
        best = np.argpartition(-ranked, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** 4
        total = weight.sum(axis=1)
        score = (weight * model.labels[best]).sum(axis=1) / np.where(total > 0, total, 1)
        out.append(np.where(total > 0, score, model.mean))
    return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame) -> Voters:
    """The voters of a bounded sample of labelled documents."""
    return fit(*labelled_sample(docs, labels, "quality", SAMPLE_DOCS, SAMPLE_CHARS))


def quality(spark: SparkSession, text: Column, model: Voters) -> Column:
    """Quality of a text from 0 to 1; null and texts of less than three bytes have the mean of the sample."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return T.by_slices(texts, lambda piece: pa.array(votes(shared.value, piece)), pa.float64())

    return score(text)
