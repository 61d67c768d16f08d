"""Jaro-Winkler over Arrow batches: numpy only, one step per character position for a whole block of pairs.

The pairs of a batch mostly repeat few texts: what a text alone decides is worked out once for each.

Positions of the second text are the bits of a word, so a step of the greedy matching is a handful of word operations
per pair. Texts of more than 64 characters take more than one word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_ROWS = 4096
_SHORT_ROWS = 16_384  # of texts of one word: enough to make a call of numpy cheap beside its work


def _matrix(texts: pa.Array, width: int) -> np.ndarray:
    """Code points of each text, padded with 0."""
    offsets, data = np.frombuffer(texts.buffers()[1], np.int32), texts.buffers()[2]
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    if raw[offsets[0] : offsets[-1]].max(initial=0) >= 128:
        return np.array(texts.to_pylist(), dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width)
    column = np.arange(width)
    out = raw[np.minimum(offsets[:-1, None] + column, len(raw) - 1)]
    out[column >= np.diff(offsets)[:, None]] = 0
    return out


def _characters(a: pa.Array, b: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as matrices of small character codes, padded with 0."""
    width = next((w for w in (8, 16, 32, 64) if w >= longest), -(-longest // 64) * 64)
    return _matrix(a, width), _matrix(b, width)


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of words, position 0 in the lowest bit of the first."""
    size = min(flags.shape[1] // 8, 8)
    return np.packbits(flags.reshape(-1), bitorder="little").view(f"u{size}").reshape(len(flags), -1)


def _ones(n: np.ndarray) -> np.ndarray:
    """Words with the lowest n bits set, n from 0 to 64."""
    full = n >= 64
    return np.where(full, ~np.uint64(0), (np.uint64(1) << np.where(full, 0, n).astype(np.uint64)) - np.uint64(1))


def _span(start: np.ndarray, stop: np.ndarray, words: int) -> np.ndarray:
    """Rows of words with the bits from ``start`` to before ``stop`` set."""
    out = np.empty((len(start), words), dtype=np.uint64)
    for k in range(words):
        low, high = np.clip(start - 64 * k, 0, 64), np.clip(stop - 64 * k, 0, 64)
        out[:, k] = _ones(high) & ~_ones(low)
    return out


def _lowest(words: np.ndarray) -> np.ndarray:
    """The lowest set bit of a row of words, as a row of words with at most one bit."""
    low = words & (~words + words.dtype.type(1))
    for k in range(1, words.shape[1]):
        low[:, k] *= ~words[:, :k].any(axis=1)
    return low


def _in_order(characters: np.ndarray, hit: np.ndarray, most: int) -> np.ndarray:
    """The matched characters of each row, moved to its start."""
    row, column = np.nonzero(hit)
    begin = np.concatenate(([0], np.cumsum(hit.sum(axis=1))))[row]
    out = np.zeros((len(hit), most), characters.dtype)
    out[row, np.arange(len(row)) - begin] = characters[row, column]
    return out


def _block(ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
    len_a, len_b = (ca != 0).sum(axis=1), (cb != 0).sum(axis=1)
    reach = np.maximum(np.maximum(len_a, len_b) // 2 - 1, 0)
    width = ca.shape[1]
    words, word = -(-width // 64), f"u{min(width // 8, 8)}"
    filled = _span(0 * len_b, len_b, words).astype(word)
    free, window, hit_a = filled.copy(), _span(0 * reach, reach, words).astype(word), np.zeros(ca.shape, dtype=bool)
    for i in range(int(len_a.max())):
        if words == 1:  # one place further; its start stays until the reach is behind
            window = window << 1 | (i <= reach)[:, None]
        else:
            window = _span(i - reach, i + reach + 1, words)
        taken = _lowest(_bits(cb == ca[:, i : i + 1]) & window & free)
        taken[i >= len_a] = 0
        free ^= taken
        hit_a[:, i] = taken.any(axis=1)
    matches = hit_a.sum(axis=1)
    hit_b = np.unpackbits((filled ^ free).view(np.uint8).reshape(-1), bitorder="little").reshape(ca.shape).view(bool)
    most = int(matches.max())
    swapped = (_in_order(ca, hit_a, most) != _in_order(cb, hit_b, most)).sum(axis=1)
    same = (ca[:, :4] == cb[:, :4]) & (ca[:, :4] != 0)
    return _boosted(len_a, len_b, matches, swapped, np.cumprod(same, axis=1).sum(axis=1))


def _boosted(len_a: np.ndarray, len_b: np.ndarray, matches: np.ndarray, swapped: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (matches / len_a + matches / len_b + (matches - swapped // 2) / matches) / 3.0
    jaro = np.where(matches > 0, jaro, 0.0)
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1.0 - jaro), jaro)


def _codes(ca: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both sides as numbers of the characters of ``cb``, from 1; what ``cb`` lacks, and the padding, is 0."""
    if cb.dtype == np.uint8 and ca.dtype == np.uint8:
        seen = np.zeros(256, bool)
        seen[cb] = True
        seen[0] = False
        number = np.where(seen, np.cumsum(seen), 0)
        return number[ca], number[cb], int(seen.sum())
    letters = np.unique(cb[cb != 0])
    number = lambda c: np.where(np.isin(c, letters), np.searchsorted(letters, c) + 1, 0)
    return number(ca), number(cb), len(letters)


def _short(ca: np.ndarray, cb: np.ndarray, which_a: np.ndarray, which_b: np.ndarray) -> np.ndarray:
    """Jaro-Winkler of the pairs ``ca[which_a]``, ``cb[which_b]`` of texts of at most 64 characters.

    A text meets many others, so the places of each of its characters are set once, as the bits of a word no longer than
    the texts need. After that a step of the matching, and of the count of matches out of order, is a look-up and a few
    operations on such words per pair, into arrays that stay in the cache.
    """
    code_a, code_b, size = _codes(ca, cb)
    word = np.dtype(f"u{cb.shape[1] // 8}")
    rows, places = np.arange(len(cb)), np.zeros((size + 1, len(cb)), dtype=word)
    for i in range(cb.shape[1]):
        places[code_b[:, i], rows] |= word.type(1 << i)
    places[0] = 0
    all_a, all_b = (ca != 0).sum(axis=1), (cb != 0).sum(axis=1)
    columns, places = np.ascontiguousarray(code_a.T.astype(np.intp)) * len(cb), places.reshape(-1)
    head_a, head_b = np.ascontiguousarray(ca[:, :4].T), np.ascontiguousarray(cb[:, :4].T)
    most, n = int(all_a.max()), min(_SHORT_ROWS, len(which_a))
    hits, steps = np.empty((2, most, n), word)  # where a character of the first text is in the second; all bits where it is taken
    at, low, flag = np.empty(n, np.intp), np.empty(n, word), np.empty(n, bool)
    out = np.empty(len(which_a))
    for start in range(0, len(which_a), _SHORT_ROWS):
        wa, wb = which_a[start : start + _SHORT_ROWS], which_b[start : start + _SHORT_ROWS]
        n = len(wa)
        at, low, flag = at[:n], low[:n], flag[:n]
        len_a, len_b = all_a[wa], all_b[wb]
        reach = np.maximum(np.maximum(len_a, len_b) // 2 - 1, 0)
        filled, window, near, far, longest = _ones(len_b).astype(word), _ones(reach).astype(word), int(reach.min()), int(reach.max()), int(len_a.max())
        free, matches, same = filled.copy(), np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        for i in range(longest):  # beyond its end a text has the padding, which has no place
            hit, taken = hits[i, :n], steps[i, :n]
            window <<= word.type(1)
            if i <= far:
                window |= word.type(1) if i <= near else i <= reach
            np.take(columns[i], wa, out=at, mode="clip")
            at += wb
            np.take(places, at, out=hit, mode="clip")
            np.bitwise_and(hit, window, out=taken)
            taken &= free
            np.negative(taken, out=low)
            taken &= low
            free ^= taken
            np.not_equal(taken, 0, out=flag)
            matches += flag.view(np.uint8)
            taken[:] = flag
            np.negative(taken, out=taken)
        left = filled ^ free
        for i in range(longest):  # the next match of one side against the next of the other
            np.negative(left, out=low)
            low &= left
            low &= steps[i, :n]
            left ^= low
            low &= hits[i, :n]
            np.not_equal(low, 0, out=flag)
            same += flag.view(np.uint8)
        alike, prefix = np.ones(n, bool), np.zeros(n, np.uint8)
        for x, y in zip(head_a, head_b):
            letter = x[wa]
            alike &= (letter == y[wb]) & (letter != 0)
            prefix += alike
        matches = matches.astype(np.int64)
        out[start : start + _SHORT_ROWS] = _boosted(len_a, len_b, matches, matches - same, prefix)
    return out


def _distinct(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different texts, and which of them each row has."""
    coded = texts.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def jaro_winkler_arrow(a: pa.Array, b: pa.Array) -> pa.Array:
    """Jaro-Winkler per row over comparison forms: prefix of up to 4, scale 0.1, boost only above 0.7. Null scores 0."""
    a, b = a.cast(pa.string()), b.cast(pa.string())
    equal = pc.equal(a, b)  # null where a side is
    equal, present = equal.fill_null(False).to_numpy(zero_copy_only=False), equal.is_valid().to_numpy(zero_copy_only=False)
    out = equal.astype(np.float64)
    todo = np.flatnonzero(present & ~equal)
    if len(todo) < len(a):
        a, b = a.take(pa.array(todo)), b.take(pa.array(todo))
    if not len(todo):
        return pa.array(out)
    (all_a, which_a), (all_b, which_b) = _distinct(a), _distinct(b)
    longest = max(pc.max(pc.utf8_length(all_a)).as_py(), pc.max(pc.utf8_length(all_b)).as_py())
    if longest <= 64 and not any(pc.any(pc.match_substring(t, "\0")).as_py() for t in (all_a, all_b)):
        out[todo] = _short(*_characters(all_a, all_b, longest), which_a, which_b)
        return pa.array(out)
    widths = pc.max_element_wise(pc.utf8_length(a), pc.utf8_length(b)).to_numpy(zero_copy_only=False)
    order = np.argsort(widths, kind="stable")  # texts of similar length share a block, long ones in smaller blocks
    start = 0
    while start < len(todo):
        stop = min(start + _ROWS, len(todo))
        while stop - start > 1 and (stop - start) * widths[order[stop - 1]] > 64 * _ROWS:
            stop = start + (stop - start) // 2
        part = order[start:stop]
        out[todo[part]] = _block(*_characters(a.take(pa.array(part)), b.take(pa.array(part)), int(widths[part[-1]])))
        start = stop
    return pa.array(out)


def jaro_winkler_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """``jaro_winkler_arrow`` over Series."""
    return pd.Series(jaro_winkler_arrow(pa.array(a, pa.string(), from_pandas=True), pa.array(b, pa.string(), from_pandas=True)).to_numpy(zero_copy_only=False), index=a.index)
