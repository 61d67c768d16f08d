"""Cosine join and identifier links against all pairs."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinfold.operators.matching import cosine_join, identifier_links, link_counts, posted_prefixes
from kinfold.operators.search import token_weights

SCHEMA = "id bigint, text string, tenant_id string, class_id string"


def _bag(text):
    return sorted("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())


def _plain(rows, threshold):
    """All pairs of the distinct bags of words of each tenant, weighed over the whole table."""
    first = {}
    for i, text, tenant, _ in sorted(rows, key=lambda r: r[0]):
        key = (tenant, tuple(_bag(text)))
        first.setdefault(key if key[1] else (tenant, i), (i, tenant, Counter(_bag(text))))
    docs = list(first.values())
    df = Counter(t for _, _, bag in docs for t in bag)
    idf = {t: math.log((len(docs) + 1) / (n + 1)) + 1 for t, n in df.items()}
    vectors = []
    for i, tenant, bag in docs:
        raw = {t: n * idf[t] for t, n in bag.items()}
        length = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append((i, tenant, {t: w / length for t, w in raw.items()}))
    found = {}
    for (i, s, a), (j, t, b) in itertools.combinations(vectors, 2):
        cosine = round(sum(w * b.get(token, 0.0) for token, w in a.items()), 4)
        if s == t and cosine >= threshold:
            found[(min(i, j), max(i, j))] = cosine
    return found


def _rows(seed, n):
    """Texts over a vocabulary of very common and rare words, a third of them one text, with blanks and nulls."""
    rng = random.Random(seed)
    words = [f"w{int(60 * rng.random() ** 3)}" for _ in range(4000)] + [f"rare{i}" for i in range(300)]
    made = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.33:
            text = rng.choice(["The common, text of ALL", "of all the common text"])
        elif kind < 0.37:
            text = rng.choice([None, "", " ,- "])
        elif kind < 0.6 and made and made[-1][1]:
            text = " ".join(made[-1][1].split()[:-1] + [rng.choice(words)])
        else:
            text = " ".join(rng.choices(words, k=rng.randint(1, 9)))
        made.append((i, text, rng.choice(["a", "a", "b", None]), "clash"))
    return made


@pytest.mark.parametrize("threshold, tile", [(0.3, 2048), (0.7, 16), (0.8, 2048)])
def test_cosine_join_finds_what_all_pairs_find(spark, threshold, tile):
    rows = _rows(7, 300)
    pairs, members = cosine_join(spark.createDataFrame(rows, SCHEMA), "id", "text", threshold, ["tenant_id"], tile)
    found = {(r.id_a, r.id_b): r.cosine for r in pairs.collect()}
    wanted = _plain(rows, threshold)
    assert wanted and found.keys() == wanted.keys() and len(found) == pairs.count()
    assert all(abs(found[p] - wanted[p]) < 2e-4 for p in wanted)
    classes = {r.id: r.class_id for r in members.collect()}
    text = {r[0]: (r[2], _bag(r[1])) for r in rows}
    assert len(classes) == len(rows)
    assert all(text[i] == text[c] and c <= i for i, c in classes.items())
    assert all(c == i for i, c in classes.items() if not text[i][1])
    counts = {r.id: r.n_links for r in link_counts(pairs, members).collect()}
    assert all(n == sum(classes[i] in p for p in wanted) for i, n in counts.items())


def test_cosine_join_of_nothing(spark):
    for rows in ([], [(1, None, "a", ""), (2, " - ", "a", "")]):
        pairs, members = cosine_join(spark.createDataFrame(rows, SCHEMA), "id", "text", 0.5)
        assert pairs.isEmpty() and members.count() == len(rows)
    with pytest.raises(ValueError):
        cosine_join(spark.createDataFrame([], SCHEMA), "id", "text", 0.0)


def test_a_word_of_all_texts_is_not_posted(spark):
    rows = [(i, f"street own{i} name{i}", "a", "") for i in range(200)]
    weights = token_weights(spark.createDataFrame(rows, SCHEMA), "id", "text")
    posted = posted_prefixes(weights, 0.7)
    assert posted.filter("token = 'street'").isEmpty()
    assert posted.select("id").distinct().count() == 200


def test_identifier_links(spark):
    rows = [("3", "t", " X@a ", 7), ("1", "t", "x@A", None), ("2", "u", "x@a", 7), ("4", "t", "", 7), ("5", "t", None, 8), ("1", "t", "x@a", None), ("6", None, "x@a", 1), ("7", None, "x@a", 2)]
    found = identifier_links(spark.createDataFrame(rows, "id string, tenant_id string, mail string, number int"), ["mail", "number"])
    assert {tuple(r) for r in found.collect()} == {("t", "mail", "1", "3", 2), ("t", "number", "3", "4", 2), (None, "mail", "6", "7", 2)}
    many = spark.range(5000).select(F.col("id"), F.lit("t").alias("tenant_id"), F.lit("same").alias("mail"))
    assert identifier_links(many, ["mail"]).count() == 4999
