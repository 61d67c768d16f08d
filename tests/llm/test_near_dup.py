import random

import numpy as np
import pytest

from kinfold.llm.near_dup import collisions_needed, near_duplicates, without_near_duplicates

from .cases import SCHEMA, WORD, changed, documents, frame, sentence


def shingle_set(text, size):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def expected(rows, size, percent):
    sets = [shingle_set(r[1], size) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((r[0], len(sets[i]), component, r[0] == component))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80), (1, 50)])
def test_against_all_pairs(spark, size, percent):
    rows = documents()
    found = near_duplicates(frame(spark, rows).withColumnRenamed("lang", "cid"), size, percent)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()), key=repr)
    assert got == expected(rows, size, percent)


def test_dense_group_over_many_tiles(spark, monkeypatch):
    from kinfold.llm import near_dup

    monkeypatch.setattr(near_dup, "TILE", 16)
    monkeypatch.setattr(near_dup, "SET_TILE", 8)
    rng = random.Random(5)
    base = sentence(rng, 60)
    rows = [(i, changed(rng, base, rng.choice([0, 1, 2, 3])), "en", "a", 1) for i in range(60)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows), 3, 85).collect()), key=repr)
    assert got == expected(rows, 3, 85)


def test_one_of_each_group_stays(spark):
    rows = documents()
    kept = without_near_duplicates(frame(spark, rows), 5, 80).collect()
    groups = {}
    for r, e in zip(sorted(rows, key=repr), sorted(expected(rows, 5, 80), key=repr)):
        groups.setdefault(e[2], set()).add(e[0])
    want = {e[2] for e in expected(rows, 5, 80)}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(w for w in want if w is not None)
    assert all(tuple(r) in rows for r in kept)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert without_near_duplicates(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_collisions_needed_falls_with_the_chance_allowed():
    assert collisions_needed(160, 85) < 136 and collisions_needed(160, 85, 1e-3) > collisions_needed(160, 85, 1e-9)


def test_components_of_a_tile_are_stars_around_the_smallest_id():
    from kinfold.llm.near_dup import _stars

    chain = np.zeros((5, 5), bool)
    chain[[0, 1, 2], [1, 2, 3]] = True
    assert sorted(_stars(chain, True, np.array([9, 5, -2, 7, 1]))) == [(-2, 5), (-2, 7), (-2, 9)]
    between = np.array([[True, False], [True, False]])
    assert sorted(_stars(between, False, np.array([4, 8, 6, 3]))) == [(4, 6), (4, 8)]


def test_few_rounds_and_frames_where_tiles_hold_whole_clusters(spark, monkeypatch):
    """Every frame written costs the driver plans, threads and garbage; the components of whole sets need no rounds."""
    from kinfold.llm import near_dup
    from kinfold.operators import cluster

    written = []
    for module in (near_dup, cluster):
        monkeypatch.setattr(module, "materialize", lambda df, *a, write=module.materialize, at=module.__name__, **k: (written.append((at, df.dtypes)), write(df, *a, **k))[1])
    rng = random.Random(7)
    words = sentence(rng, 80).split()
    rows = [(i, " ".join(words[i:i + 60]), "en", "a", 1) for i in range(12)]  # a chain: neighbours alike, ends not
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows), 3, 85).collect()), key=repr)
    assert got == expected(rows, 3, 85)
    rounds = [types for at, types in written if at == "kinfold.operators.cluster"]
    assert all(types == [("u", "bigint"), ("v", "bigint")] for types in rounds)
    own = [k for k, (at, _) in enumerate(written) if at == "kinfold.llm.near_dup"]
    assert len(own) == 10
    assert own[8] - own[7] == 2  # the links of whole sets are components as they are
