"""Joins that compare only what letter counts allow, against all pairs."""

import contextlib
import io
import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.functions import jaro
from kinfold.functions.text import levenshtein_similarity
from kinfold.operators import blocking, bounds, compare, dedup, search
from kinfold.operators.dedup import dedup_fuzzy
from kinfold.plans.resolution import MatchSpec, linked_pairs, matched_pairs
from kinfold.session import materialize

from .test_resolution import plain_jaro_winkler


def bent(rng, text):
    """One to four random letters replaced, dropped, doubled, swapped or put in."""
    for _ in range(rng.randint(1, 4)):
        k = rng.randrange(len(text) + 1)
        text = rng.choice([text[:k] + text[k + 1:], text[:k] + rng.choice("aeéxß 日") + text[k:], text[:k] + text[k + 1: k + 2] + text[k: k + 1] + text[k + 2:], text[:k] + text[:k][-1:] + text[k:]])
    return text or "a"


def texts(rng, n):
    base = ["".join(rng.choice("aaeeiinnrrstloucdmhgbxq é") for _ in range(rng.randint(1, 18))) for _ in range(n // 3)]
    return [*base, *(bent(rng, b) for b in base), *(bent(rng, bent(rng, b)) for b in base), "a" * 300, "ab" * 150, "é" * 20, "éa" * 10]


def test_bounds_are_never_below_the_similarity(spark):
    rng = random.Random(5)
    some = texts(rng, 60)
    rows = [(a, b) for a, b in itertools.product(some, some)][::3] + [("", ""), ("", "a"), (None, "a"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"x": bounds.marks(F.col("a")), "y": bounds.marks(F.col("b"))})
    found = df.select("a", "b", bounds.jaro_winkler_bound(F.col("x"), F.col("y"), F.col("a"), F.col("b")).alias("jw"), bounds.levenshtein_bound(F.col("x"), F.col("y")).alias("lev"),
                      levenshtein_similarity(F.col("a"), F.col("b")).alias("edit")).collect()
    for r in found:
        if r.a and r.b:
            exact = 1.0 if r.a == r.b else plain_jaro_winkler(r.a, r.b)
            assert exact <= r.jw + 1e-9 <= 1 + 2e-9
        if r.a and r.b and r.a == r.a.strip() and r.b == r.b.strip():  # the function compares trimmed texts
            assert r.edit <= r.lev + 1e-9
    assert {(r.a, r.b): (r.jw, r.lev) for r in found[-4:]} == {("", ""): (1.0, 1.0), ("", "a"): (0.0, 0.0), (None, "a"): (0.0, 0.0), (None, None): (0.0, 0.0)}


@pytest.mark.parametrize("threshold", [0.95, 0.85, 0.75, 0.6])
def test_no_pair_above_the_threshold_is_lost(spark, threshold):
    rng = random.Random(int(100 * threshold))
    rows = [(f"{i:03d}", rng.choice("gh"), t) for i, t in enumerate(texts(rng, 150))] + [("900", None, "anna"), ("901", None, "annah"), ("902", "g", "xyzzy"), ("903", "g", "xyzzy")]
    df = spark.createDataFrame(rows, "id string, g string, t string").withColumn("_m", F.lit("clash")).fillna("", ["g"])
    wanted = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and (a[2] == b[2] or plain_jaro_winkler(a[2], b[2]) >= threshold)}
    for rows_per_tile in (5, 2048):
        found = bounds.jaro_winkler_candidates(df, ["g"], "id", "t", threshold, rows_per_tile)
        assert wanted <= {(min(r.id_a, r.id_b), max(r.id_a, r.id_b)) for r in found.collect()}
    assert bounds.jaro_winkler_candidates(df.limit(0), ["g"], "id", "t", threshold).count() == 0


def test_few_pairs_pass_the_bound(spark):
    """What the similarity itself has to look at stays a small share of all pairs of a block."""
    rng = random.Random(9)
    syllables = ["ka", "lin", "mor", "tes", "ul", "brin", "gos", "dav", "ney", "hol", "ri", "pe", "zan", "wick", "fa", "jun"]
    names = sorted({" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 3))) for _ in range(2)) for _ in range(1500)})
    df = spark.createDataFrame([(f"{i:05d}", "b", n) for i, n in enumerate(names)], "id string, g string, t string")
    found = bounds.jaro_winkler_candidates(df, ["g"], "id", "t", 0.85).select(F.least("id_a", "id_b"), F.greatest("id_a", "id_b")).distinct().count()
    assert found < 0.1 * len(names) * (len(names) - 1) / 2


def test_fuzzy_dedup_drops_what_all_pairs_drop(spark):
    rng = random.Random(12)
    rows = [(f"{i:03d}", t, rng.choice("AB")) for i, t in enumerate(texts(rng, 160))]
    rows += [("900", "", "A"), ("901", None, "A"), ("902", rows[0][1], rows[0][2]), ("903", "anna", None), ("904", "annа", None)]
    blank = lambda t: not (t or "").strip()
    dropped = {b[0] for a, b in itertools.combinations(rows, 2) if (a[2] or "") == (b[2] or "") and not blank(a[1]) and not blank(b[1]) and (a[1] == b[1] or plain_jaro_winkler(a[1], b[1]) >= 0.85)}
    df = spark.createDataFrame(rows, "id string, name string, country string").withColumn("few", F.lit(1))
    for rows_per_tile in (7, 2048):
        assert {r["id"] for r in dedup_fuzzy(df, rows_per_tile=rows_per_tile).collect()} == {r[0] for r in rows} - dropped


@pytest.mark.parametrize("weights", [{"name": 0.5, "dob": 0.2, "email": 0.3}, {"name": 1.0}, {"code": 1.0}, {"email": 0.6, "code": 0.4, "absent": 0.5}])
def test_links_are_all_pairs_that_reach_the_score(spark, weights):
    rng = random.Random(21)
    some = texts(rng, 60)
    value = lambda: rng.choice([None, "", rng.choice(some), rng.choice(some)])
    rows = [(f"{i:03d}", "t", value(), rng.choice([None, "1990-01-02", "1990-01-20", "2001-12-31"]), value(), value(), rng.choice(["b", "EMPTY_X"])) for i in range(160)]
    df = spark.createDataFrame(rows, "id string, tenant_id string, name string, dob string, email string, code string, block_key string")
    profs = blocking.stored_profiles(df, list(weights))
    for review in (0.7, 0.5):
        spec = MatchSpec(weights=weights, review=review, rows_per_tile=30)
        every = compare.score_pairs(blocking.candidate_pairs(profs, list(weights)), weights).filter(F.col("confidence_score") >= review)
        key = lambda r: (r.id_a, r.id_b, r.confidence_score, r.record_pairs)
        assert sorted(map(key, linked_pairs(profs, spec).collect())) == sorted(map(key, every.collect()))


def test_no_text_is_held_against_all_earlier_ones_once_an_early_one_removes_it(spark, monkeypatch):
    """Of a block of near copies only the few that no early text removes reach the join with all earlier texts."""
    asked = []
    plain = dedup.jaro_winkler_candidates

    def seen(df, group, id_col, text_col, threshold, rows_per_tile, some):
        asked.append(some.count())
        return plain(df, group, id_col, text_col, threshold, rows_per_tile, some)

    monkeypatch.setattr(dedup, "jaro_winkler_candidates", seen)
    rows = [(f"{i:04d}", f"{head} person {chr(97 + i % 26)}{chr(97 + i // 26)}", "A") for i, head in enumerate(["anna", "hugo"] * 300)]
    df = spark.createDataFrame(rows, "id string, name string, country string")
    kept = {r["id"] for r in dedup_fuzzy(df).collect()}
    assert kept == {b[0] for i, b in enumerate(rows) if not any(plain_jaro_winkler(a[1], b[1]) >= 0.85 for a in rows[:i])}
    assert asked[0] < 20


def test_only_pairs_that_may_match_are_scored_for_matches(spark):
    """Pairs for review grow with the square of a block without names; clusters do not need them."""
    rows = [(f"{i:03d}", "t", None, f"19{10 + i % 80}-0{1 + i % 9}-1{i % 10}", f"{chr(98 + i % 20)}a{chr(98 + i % 7)}a@example.com", "EMPTY_X") for i in range(120)]
    df = spark.createDataFrame(rows, "id string, tenant_id string, name string, dob string, email string, block_key string")
    profs = blocking.stored_profiles(df, ["name", "dob", "email"])
    every = linked_pairs(profs).filter("decision = 'match'")
    key = lambda r: (r.id_a, r.id_b, r.confidence_score, r.decision, r.record_pairs)
    assert sorted(map(key, matched_pairs(profs).collect())) == sorted(map(key, every.collect()))
    marked = compare.with_marks(profs, compare.DEFAULT_WEIGHTS)
    met = lambda least: blocking.candidate_pairs(marked, list(compare.DEFAULT_WEIGHTS), where=compare.may_reach(profs.columns, compare.DEFAULT_WEIGHTS, least)).count()
    assert 5 * met(0.9) < met(0.7)


def _generated(df) -> list[int]:
    """Sizes of the largest methods of the code Spark makes for a frame."""
    adaptive = df.sparkSession.conf.get("spark.sql.adaptive.enabled")
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.explain("codegen")
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", adaptive)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]


def test_the_join_on_letters_is_compiled(spark):
    """The JVM only interprets methods of more than 8000 bytes, which makes each pair of a block many times dearer."""
    rows = [(f"{i:03d}", "t", f"n{i}", "1990-01-02", f"n{i}@example.com", "b") for i in range(20)]
    profs = blocking.stored_profiles(spark.createDataFrame(rows, "id string, tenant_id string, name string, dob string, email string, block_key string"), ["name", "dob", "email"])
    sizes = _generated(linked_pairs(profs))
    assert sizes and max(sizes) < 8000


def test_values_of_profiles_are_not_normalised_again_for_each_pair(spark):
    rows = [(f"{i:03d}", "t", f" N{i}", "1990-01-02", None, "b") for i in range(5)]
    profs = blocking.stored_profiles(spark.createDataFrame(rows, "id string, tenant_id string, name string, dob string, email string, block_key string"), ["name", "dob", "email"])
    met = blocking.candidate_pairs(profs, ["name", "dob", "email"])
    plain, again = compare.score_pairs(met, normalized=True), compare.score_pairs(met)
    key = lambda r: (r.id_a, r.id_b, r.score_name, r.score_dob, r.score_email, r.confidence_score)
    assert sorted(map(key, plain.collect())) == sorted(map(key, again.collect()))
    for frame in (plain, linked_pairs(profs)):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            frame.explain()
        assert "trim" not in text.getvalue().lower()


def test_letter_bounds_of_columns_are_never_below_the_similarity(spark):
    rng = random.Random(6)
    some = [*texts(rng, 60), "日本語ペ", "日本語本", "가나다힣", "가나다라"]
    rows = [(a, b) for a, b in itertools.product(some, some)][::3]
    df = bounds.marked(spark.createDataFrame(rows, "a string, b string"), {"_x": F.col("a"), "_y": F.col("b")})
    x, y = bounds.mark_columns("_x"), bounds.mark_columns("_y")
    for r in df.select("a", "b", bounds.jaro_winkler_upto(x, y).alias("jw"), bounds.levenshtein_upto(x, y).alias("lev"), F.levenshtein("a", "b").alias("d")).collect():
        assert (1.0 if r.a == r.b else plain_jaro_winkler(r.a, r.b)) <= r.jw + 1e-9
        assert 1 - r.d / max(len(r.a), len(r.b)) <= r.lev + 1e-9


def test_a_text_that_meets_many_is_prepared_once(monkeypatch):
    """Batches of pairs repeat few texts; what a text alone decides is not worked out for each pair."""
    rng, seen = random.Random(7), []
    some = [*texts(rng, 60)[:-4], "", "a" * 64, "b" * 33, "éa" * 31]
    rows = [(a, b) for a in some[:40] for b in some]
    plain = jaro._characters
    monkeypatch.setattr(jaro, "_characters", lambda a, b, longest: seen.append(len(a) + len(b)) or plain(a, b, longest))
    found = jaro.jaro_winkler_arrow(*(pa.array(side, pa.string()) for side in zip(*rows))).to_pylist()
    assert sum(seen) <= 2 * len(some)
    for (a, b), score in zip(rows, found):
        assert score == pytest.approx(1.0 if a == b else plain_jaro_winkler(a, b) if a and b else 0.0, abs=1e-12)


def test_cosine_of_pairs_that_bring_their_vectors_moves_no_pair(spark):
    rows = [(f"{i:02d}", "t", t, "b") for i, t in enumerate(["anna maria berg", "berg anna", "hugo", "", None, "anna anna", "Hugo"])]
    df = spark.createDataFrame(rows, "id string, tenant_id string, name string, block_key string")
    profs = blocking.stored_profiles(df, ["name"])
    weights = search.token_weights(profs, "profile_id", "name")
    vectors = materialize(search.with_vectors(profs, weights, "profile_id").drop("name"))
    met = blocking.candidate_pairs(vectors, ["vector"])
    brought = search.tfidf_cosine(met)
    key = lambda r: (r.id_a, r.id_b, r.tfidf_cosine)
    joined = search.tfidf_cosine(blocking.candidate_pairs(profs, ["name"]).select("id_a", "id_b"), weights).collect()
    assert sorted(map(key, brought.collect())) == sorted(map(key, joined)) and len(joined) == 10
    held = {(w.id, w.token): w.weight for w in weights.collect()}
    for r in joined:
        assert r.tfidf_cosine == round(sum(w * held.get((r.id_b, t), 0.0) for (i, t), w in held.items() if i == r.id_a), 4)
    shuffles = lambda frame: frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(search.tfidf_cosine(met)) == shuffles(met)


def test_a_filter_on_the_scores_scores_no_pair_again(spark):
    """Spark pushes a filter on a score below it, and with it a second evaluation, unless the score says that it must not."""
    rows = [(f"{i:03d}", "t", f"n{i}", "1990-01-02", f"n{i}@example.com", "b") for i in range(20)]
    profs = blocking.stored_profiles(spark.createDataFrame(rows, "id string, tenant_id string, name string, dob string, email string, block_key string"), ["name", "dob", "email"])
    steps = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    assert steps(linked_pairs(profs)) == steps(linked_pairs(profs).filter("decision = 'review'")) == 1
    assert steps(compare.score_pairs(blocking.candidate_pairs(profs, ["name", "email"])).filter("confidence_score > 0.8")) == 1


def test_batches_of_short_texts_score_by_the_definition_whatever_their_length():
    """Words of the matching are as short as the texts of a batch let them be, and a batch may be longer than a block of it."""
    rng = random.Random(8)
    for longest in (5, 8, 9, 16, 17, 32, 33, 64):
        some = ["".join(rng.choice("abcé日 ") for _ in range(rng.randint(1, longest))) for _ in range(9)] + ["a" * longest, "ab" * (longest // 2)]
        rows = [(a, b) for a, b in itertools.product(some, some)]
        again = 1 + 2 * jaro._SHORT_ROWS // len(rows) if longest == 17 else 1
        found = jaro.jaro_winkler_arrow(*(pa.array(side * again, pa.string()) for side in zip(*rows))).to_pylist()
        expected = [1.0 if a == b else plain_jaro_winkler(a, b) for a, b in rows]
        assert found == pytest.approx(expected * again, abs=1e-12)
