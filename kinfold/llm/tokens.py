"""Words, hashes and shingles of whole batches of texts at once, as numpy arrays.

A batch is one byte buffer with document offsets. A word is a maximal run of bytes other than space and the controls
9 to 13; in UTF-8 that is the run of characters with the same property. Word and shingle hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_STEP = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def mix32(x: np.ndarray, seed: int) -> np.ndarray:
    """A seeded one-to-one scramble of 32-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint32(seed & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return x ^ (x >> np.uint32(16))


def _cuts(column: pa.Array, limit: int) -> list[tuple[int, int]]:
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            out.append((start, i))
            start, held = i, 0
        held += int(n)
    return [*out, (start, len(sizes))] if start < len(sizes) else out


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds about ``limit`` bytes of text, or a single longer row."""
    for a, b in _cuts(batch.column(batch.schema.get_field_index(text)), limit):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Hand memory that Arrow holds but does not use back to the system.

    A Python worker outlives its tasks; without this it stays as large as the most it has ever held in pieces.
    """
    pa.default_memory_pool().release_unused()


def give_back_arrays() -> None:
    """Hand back what the C library keeps of freed arrays too, where it can (glibc).

    Takes longer than ``give_back``: for the end of a piece of work that the process outlives by far.
    """
    give_back()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_slices(column: pa.Array, function: Callable[[pa.Array], pa.Array], kind: pa.DataType, limit: int = 1 << 20) -> pa.Array:
    """``function`` over pieces of a string column of about ``limit`` bytes, put together again."""
    return pa.concat_arrays([pa.array([], kind), *(function(column.slice(a, b - a)) for a, b in _cuts(column, limit))])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (rows + 1); a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    marks = np.frombuffer(offsets, np.int64)[wide.offset: wide.offset + len(wide) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[marks[0]: marks[-1]], marks - marks[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] |= 32
    return out


@dataclass
class Words:
    """Start and end byte, document and hash of every word, and where each document's words begin (documents + 1)."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        done = 1
        while done < n:
            take = min(done, n - done)
            up[done: done + take] = up[:take] * np.uint64(pow(_BASE, done, 1 << 64))
            down[done: done + take] = down[:take] * np.uint64(pow(inverse, done, 1 << 64))
            done += take
    return up, down


_UP, _DOWN = _powers(_STEP)


class SpanHash:
    """64-bit hashes of byte spans of one buffer, from running sums of bytes times powers of an odd base.

    The sums run in blocks so that the powers fit a fixed table; a span that crosses blocks is put together from them.
    """

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            n = len(data)
            blocks = -(-max(n, 1) // _STEP)
            padded = np.zeros(blocks * _STEP, np.uint64)
            padded[:n] = data
            padded[:n] += np.uint64(1)
            padded = padded.reshape(blocks, _STEP)
            padded *= _UP
            self.sums = np.zeros((blocks, _STEP + 1), np.uint64)
            np.cumsum(padded, axis=1, out=self.sums[:, 1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans ``start:end``; equal bytes have equal hashes wherever they stand."""
        if not len(start):
            return np.zeros(0, np.uint64)
        sums = self.sums
        with np.errstate(over="ignore"):
            b0, o0 = np.divmod(start, _STEP)
            b1, o1 = np.divmod(end - 1, _STEP)
            o1 = o1 + 1
            flat, width = sums.ravel(), _STEP + 1
            value = (flat[b1 * width + o1] - flat[b0 * width + o0]) * _DOWN[o0]
            for i in np.flatnonzero(b0 != b1):
                head = (sums[b0[i], _STEP] - sums[b0[i], o0[i]]) * _DOWN[o0[i]]
                shift, rest = int(_STEP - o0[i]), np.uint64(0)
                for b in range(int(b0[i]) + 1, int(b1[i]) + 1):
                    part = sums[b, o1[i] if b == b1[i] else _STEP]
                    rest = rest + part * np.uint64(pow(_BASE, shift + (b - int(b0[i]) - 1) * _STEP, 1 << 64))
                value[i] = head + rest
            return mix(value + (end - start).astype(np.uint64) * _ODD)


def spans(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that do not cross documents: start, end, document, first run of each document."""
    n = len(keep)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], keep))
    after = np.concatenate((keep, [False]))
    start = np.flatnonzero(after & (~before | edge))
    start = start[start < n]
    end = np.flatnonzero(before & (~after | edge))
    end = end[end > 0]
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return start, end, doc, first


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """All words of a batch."""
    keep = (data != 32) & ((data < 9) | (data > 13))
    start, end, doc, first = spans(keep, offsets)
    return Words(start, end, doc, SpanHash(data)(start, end), first)


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, first)``: hashes of runs of ``size`` words; a shorter document with words has its whole sequence as one.

    The hash depends on the words, their order and their number. Repeats within a document stay.
    """
    counts = np.diff(found.first)
    per_doc = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(per_doc)))
    doc = np.repeat(np.arange(len(counts)), per_doc)
    at = found.first[doc] + (np.arange(first[-1]) - first[doc])
    length = np.minimum(counts[doc], size)
    with np.errstate(over="ignore"):
        value = np.zeros(len(at), np.uint64)
        for k in range(size):
            here = k < length
            term = found.hash[np.where(here, at + k, 0)] if len(found.hash) else np.zeros(len(at), np.uint64)
            value = np.where(here, mix(value * np.uint64(0xD6E8FEB86659FD93) + term + _ODD), value)
        return mix(value + length.astype(np.uint64)), first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and where each document's values begin."""
    values = values.copy()
    for a, b in zip(first[:-1], first[1:]):
        values[a:b].sort()
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    doc = doc[new]
    return values[new], np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(first) - 1))))


def fold(function: np.ufunc, values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """``function.reduceat`` by document, with ``empty`` for documents without values."""
    lengths = np.diff(first)
    out = np.full(len(lengths), empty, values.dtype)
    full = lengths > 0
    if full.any():
        out[full] = function.reduceat(values, first[:-1][full])
    return out


def ragged(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values by document as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
