import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinfold.llm import spelling as S

from .cases import SCHEMA


def counted(rows, every):
    found = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def expected(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and distance(w, v) == 1] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def texts(seed=6):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeÉéÿ×") for _ in range(rng.randint(4, 9))) for _ in range(25)] + ["aaaaaa", "aaaaa", "aaaaaaa", "Aaaab" * 900]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(1, 30)):
            w = base[min(rng.randrange(len(base)), rng.randrange(len(base)))]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "Z", "éa"]) + w[k + 1:]
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "\n", "日", "1"]).join(words), "en", "a", 1))
    return rows + [(None, rows[0][1], "en", "a", 1)] * 2 + [(900, None, "en", "a", 1), (901, "", "en", "a", 1), rows[5], rows[5]]


@pytest.mark.parametrize("tile,every", [(S.TILE, 97), (12, 3), (1, None)])
def test_against_all_pairs(spark, tile, every):
    rows = texts()
    words = counted(rows, every)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("clash")).withColumn("run", F.lit(1))
    found = S.spelling_groups(S.word_counts(df, every=every), tile=tile)
    got = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()), key=repr)
    assert got == expected(words) and any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_words_of_one_leaf_and_of_no_rows(spark):
    words = {"".join(p): 3 + i * i for i, p in enumerate(__import__("itertools").permutations("abcde"))}
    df = spark.createDataFrame(list(words.items()) + [("", 5), (None, 5), ("xyzzy", None)], "word string, n long")
    got = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in S.spelling_groups(df, tile=10).collect()), key=repr)
    assert got == expected(words)
    assert S.spelling_groups(df.limit(0)).count() == 0


def test_a_long_chain_of_forms(spark):
    rows = [("a" * (5 + i), 3 ** (i + 1)) for i in range(12)]
    got = S.spelling_groups(spark.createDataFrame(rows, "word string, n long")).collect()
    assert {r.root for r in got} == {"a" * 16} and {r.word: r.n_near for r in got}["a" * 7] == 2
