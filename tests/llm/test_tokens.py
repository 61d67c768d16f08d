import random

import numpy as np
import pyarrow as pa

from kinfold.llm import tokens as T

from .cases import WORD


def test_words_and_shingles_match_a_plain_reading():
    rng = random.Random(4)
    texts = [None, "", " ", "a", " a\tb\n", "é ß 日本"] + [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 50))) for _ in range(40)]
    texts += ["z" * 140_000, "y " + "z" * 140_000, "x" * 65_535 + " " + "w" * 65_537]
    data, offsets = T.buffers(pa.array(texts))
    found = T.words(data, offsets)
    names: dict[str, int] = {}
    for i, text in enumerate(texts):
        a, b = found.first[i], found.first[i + 1]
        want = WORD.findall(text or "")
        assert [bytes(data[s:e]).decode() for s, e in zip(found.start[a:b], found.end[a:b])] == want
        assert all(names.setdefault(w, h) == h for w, h in zip(want, found.hash[a:b].tolist()))
    assert len(set(names.values())) == len(names)
    hashes, first = T.shingles(found, 3)
    seen: dict[tuple, int] = {}
    for i, text in enumerate(texts):
        w = WORD.findall(text or "")
        runs = [tuple(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] * bool(w)
        got = hashes[first[i]: first[i + 1]].tolist()
        assert len(got) == len(runs) and all(seen.setdefault(r, h) == h for r, h in zip(runs, got))
    assert len(set(seen.values())) == len(seen)


def test_distinct_and_fold():
    values, first = T.distinct(np.array([3, 1, 3, 2, 2], np.uint64), np.array([0, 3, 3, 5]))
    assert values.tolist() == [1, 3, 2] and first.tolist() == [0, 2, 2, 3]
    assert T.fold(np.add, values, first, 9).tolist() == [4, 9, 2]


def test_slices_keep_every_row():
    column = pa.array([None, "a" * 10, "b" * 50, "", "c"])
    assert T.by_slices(column, lambda c: c.fill_null("-"), pa.string(), 12).to_pylist() == ["-", "a" * 10, "b" * 50, "", "c"]
    assert T.by_slices(column.slice(0, 0), lambda c: c, pa.string()).to_pylist() == []
