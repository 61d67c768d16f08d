import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import jaro
from kinfold.functions.text import jaro_winkler, levenshtein_distance, levenshtein_similarity, metaphone
from kinfold.operators import blocking, cluster, compare, golden, pairing
from kinfold.operators.dedup import dedup_exact, dedup_fuzzy, name_passes
from kinfold.plans.resolution import MatchSpec, decision_counts, drop_decided, linked_pairs, resolve
from kinfold.session import materialize

PAIRS = [
    ("Katrina", "katrine", 0.9428571), ("Marcella", "Marcelal", 0.975), ("Thomas", "Thom", 0.9333333), ("Rosalind", "Lind", 0.0), ("Otto", "Xenia", 0.0), ("D'Arcy", "DArcy", 0.95), ("kim@mail.test", "kim@mial.test", 0.9846154),
    ("  Kim ", "KIM", 1.0), (None, None, 0.0), ("Kim", None, 0.0), ("", "", 1.0), ("Kim", "", 0.0),
]


def plain_jaro_winkler(a: str, b: str) -> float:
    """The published definition, one pair at a time."""
    reach, taken, found = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, ch in enumerate(a):
        hit = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == ch), None)
        if hit is not None:
            taken.add(hit)
            found.append(ch)
    if not found:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(found, sorted(taken))) // 2
    m = len(found)
    score = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a[:4], b[:4]))))
    return score + prefix * 0.1 * (1 - score) if score > 0.7 else score


def test_similarities(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in PAIRS], "a string, b string")
    got = [r[0] for r in df.select(jaro_winkler(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([s for _, _, s in PAIRS], abs=1e-6)
    row = spark.createDataFrame([("1990-01-01", "1990-01-02", "12345", "12346", "Müller", "Muller")], "a string, b string, c string, d string, e string, f string").select(
        levenshtein_similarity(F.col("a"), F.col("b")), levenshtein_distance(F.col("c"), F.col("d")), levenshtein_distance(F.col("c"), F.lit(None)), jaro_winkler(F.col("e"), F.col("f"))
    ).first()
    assert row[0] == pytest.approx(0.9) and row[1] == 1 and row[2] == 5 and row[3] == pytest.approx(0.9)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeé 日", min_size=1, max_size=90), st.text("abcdeé 日", min_size=1, max_size=90))
def test_batches_follow_the_definition(a, b):
    import pandas as pd

    got = jaro.jaro_winkler_batch(pd.Series([a, a, None]), pd.Series([b, a, b])).tolist()
    assert got == pytest.approx([1.0 if a == b else plain_jaro_winkler(a, b), 1.0, 0.0])


def test_block_keys_follow_from_the_letters_of_a_name(spark):
    """Case, blanks and signs around and inside a name change no key; the country and the type always do."""
    rng = random.Random(31)
    rows = []
    for i in range(120):
        name = " ".join("".join(rng.choice("abdeiklmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 2)))
        noisy = "".join(rng.choice((c, c.upper())) + rng.choice(("", "", "-", "'", "7")) for c in name)
        rows.append((i, rng.choice(["", "  ", "\t"]) + noisy + rng.choice(["", " ", "\n"]), name, rng.choice(["se", "it"]), rng.choice(["person", "org unit"])))
    df = spark.createDataFrame(rows, "i int, noisy string, plain string, land string, kind string")
    of = lambda n, c, t: blocking.block_key(F.col(n), c, t)
    land, kind, none = F.col("land"), F.col("kind"), F.lit(None).cast("string")
    keys = df.select(
        of("plain", land, kind).alias("a"), of("noisy", F.concat(F.lit(" "), F.upper(land)), F.concat(F.upper(kind), F.lit(" "))).alias("b"),
        of("plain", F.lit("xx"), kind).alias("c"), of("plain", none, F.lit(" ")).alias("d"), metaphone(F.col("plain")).alias("code"), "land", "kind").collect()
    assert len({r.a for r in keys}) > 60
    for r in keys:
        assert r.a == r.b == f"{r.code}_{r.land.upper()}_{r.kind.title()}" and r.a != r.c and r.d == f"{r.code}_GLOBAL_DEFAULT"


def test_names_without_letters_share_the_empty_block(spark):
    rows = [(n,) for n in (None, "", "\t \n", "0", "42-17", "...", "日本")]
    keys = spark.createDataFrame(rows, "n string").select(blocking.block_key(F.col("n"), F.lit("jp"), F.lit("thing")).alias("k")).distinct().collect()
    assert [r.k for r in keys] == ["EMPTY_JP_Thing"]


def test_phonetic_codes(spark):
    """One case for each rule: silent kn and gn, ph, gh, th, ch, sch, soft and hard c and g, x, w, doubled letters."""
    alike = [("Knut", "Nut"), ("Gnom", "Nom"), ("Philip", "Filip"), ("Thilo", "0ilo"), ("Anna", "Ana"), ("Cesar", "Sesar"), ("Carl", "Karl"), ("Axel", "Aksel")]
    apart = [("Thea", "Tea"), ("Chris", "Kriz b"), ("Schmidt", "Midt"), ("Vera", "Bera")]
    df = spark.createDataFrame([(a, b) for a, b in alike + apart], "a string, b string").select("a", metaphone(F.col("a")).alias("x"), metaphone(F.col("b")).alias("y"))
    found = {r["a"]: (r["x"], r["y"]) for r in df.collect()}
    same = {a for a, (x, y) in found.items() if x == y}
    assert {a for a, _ in alike} - {"Thilo"} <= same and not {a for a, _ in apart} & same, found


def test_blocking_reduction_is_one_minus_pairs_within_blocks(spark):
    rng = random.Random(32)
    rows = [(rng.choice("tuv"), str(i), rng.choice("abcdefgh")) for i in range(130)] + [("lone", "x", "a")]
    found = {r["tenant_id"]: r for r in blocking.blocking_reduction(spark.createDataFrame(rows, "tenant_id string, id string, block_key string")).collect()}
    for tenant, row in found.items():
        own = [r for r in rows if r[0] == tenant]
        all_pairs = list(itertools.combinations(own, 2))
        inside = sum(a[2] == b[2] for a, b in all_pairs)
        assert (row["records"], row["pairs"]) == (len(own), inside)
        assert row["reduction_ratio"] == pytest.approx(1 - inside / len(all_pairs) if all_pairs else 1.0)


def test_pair_scores(spark):
    rows = [("Lena Vogt", "lena vohgt", "1971-05-06", "1971-05-06", "l@v.de", "l@v.de"), ("Lena", "Xaver", "1971-05-06", "2003-11-22", "l@v.de", "qq"), (None, None, None, None, None, None), ("Kim", "Kim", "1971-05-06", None, None, None)]
    df = spark.createDataFrame(rows, "name_a string, name_b string, dob_a string, dob_b string, email_a string, email_b string")
    scores = [r["confidence_score"] for r in compare.score_pairs(df).collect()]
    assert scores[0] == pytest.approx(0.5 * plain_jaro_winkler("lena vogt", "lena vohgt") + 0.5, abs=1e-4)
    assert scores[1] < 0.6 and scores[2] == 0.0 and scores[3] == pytest.approx(0.5 / 0.7, abs=1e-4)


def test_decisions_change_at_the_bounds(spark):
    for match, review in ((compare.MATCH, compare.REVIEW), (0.5, 0.25), (1.0, 0.0)):
        scores = [0.0, 1.0, match, review, match - 1e-4, match + 1e-4, review - 1e-4, review + 1e-4, (match + review) / 2]
        df = spark.createDataFrame([(s,) for s in scores], "confidence_score double")
        parts = dict(zip(("match", "review", "non_match"), compare.classify_pairs(df, match=match, review=review)))
        for r in compare.with_decision(df, match=match, review=review).collect():
            assert r["decision"] == ("match" if r["confidence_score"] >= match else "review" if r["confidence_score"] >= review else "non_match")
        assert sorted(r[0] for d in parts.values() for r in d.collect()) == sorted(scores)
        assert all(d.filter(F.col("decision") != name).isEmpty() for name, d in parts.items())
    with pytest.raises(ValueError):
        compare.classify_pairs(spark.createDataFrame([(1.0,)], "other double"))


def _components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_are_the_transitive_closure(spark):
    random.seed(3)
    chain = [(f"{i:04d}", f"{i + 1:04d}") for i in range(300, 360)]
    hub = [("0500", f"{i:04d}") for i in range(501, 700)]
    loose = [tuple(f"{random.randint(0, 250):04d}" for _ in range(2)) for _ in range(150)]
    edges = [e for e in chain + hub + loose if e[0] != e[1]]
    found = cluster.connected_components(spark.createDataFrame(edges, "id_a string, id_b string")).collect()
    assert {r["id"]: r["cluster_id"] for r in found} == _components(edges)


def test_equal_ids_of_two_tenants_stay_apart(spark):
    edges = spark.createDataFrame([("t1", "1", "2"), ("t2", "2", "3")], "tenant_id string, id_a string, id_b string")
    found = {(r["tenant_id"], r["id"]): r["cluster_id"] for r in cluster.connected_components(edges, scope=["tenant_id"]).collect()}
    assert found == {("t1", "1"): "1", ("t1", "2"): "1", ("t2", "2"): "2", ("t2", "3"): "2"}


def test_numbers_stay_numbers_unless_taken_as_text(spark):
    edges = spark.createDataFrame([(10, 9), (10, 11), (-3, 2), (None, 5)], "a bigint, b bigint")
    found = cluster.connected_components(edges, "a", "b", as_text=False)
    assert found.dtypes == [("id", "bigint"), ("cluster_id", "bigint")]
    assert sorted(map(tuple, found.collect())) == [(-3, -3), (2, -3), (9, 9), (10, 9), (11, 9)]


def test_singletons_stay_clusters(spark):
    records = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    comps = cluster.connected_components(spark.createDataFrame([("1", "2"), ("1", "9")], "id_a string, id_b string"))
    assert {r["id"]: r["cluster_id"] for r in cluster.attach_clusters(records, comps).collect()} == {"1": "1", "2": "1", "3": "3"}


def _names(n, seed):
    random.seed(seed)
    base = ["".join(random.choice("aeioubcdlmnrst") for _ in range(random.randint(1, 14))) for _ in range(n // 2)]
    bent = ["".join(c if random.random() > 0.12 else random.choice("aeiouxyz") for c in b) for b in base]
    return sorted(set(base + bent))


def test_passes_pair_what_shares_a_key_whatever_the_tiles(spark):
    random.seed(7)
    rows = [(i, random.choice("gh"), random.choice(["", None, "x", "y"]), random.choice([None, "p", "q"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, g string, one string, two string")
    wanted = sorted(
        (a[0], b[0]) for a, b in itertools.combinations(rows, 2)
        if a[1] == b[1] and ((a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3]))
    )
    for rows_per_tile in (3, 10_000):
        found = pairing.pass_pairs(df, ["g"], "id", [F.col("one"), F.col("two")], ["one"], rows_per_tile)
        assert sorted((r["id_a"], r["id_b"]) for r in found.collect()) == wanted
    assert found.columns == ["g", "id_a", "one_a", "id_b", "one_b"]


def test_fuzzy_dedup_by_passes_whatever_the_tiles(spark):
    firsts, lasts = _names(12, 9), _names(20, 5)
    random.seed(2)
    rows = [(f"{i:04d}", f"{random.choice(firsts)} {random.choice(lasts)}", random.choice("AB")) for i in range(300)]
    met = lambda a, b: a[0] == b[0] and a.split(" ")[-1] == b.split(" ")[-1]
    codes = dict(spark.createDataFrame([(r[1],) for r in rows], "n string").distinct().select("n", metaphone(F.col("n"))).collect())
    dropped = {
        b[0] for a, b in itertools.combinations(rows, 2)
        if a[2] == b[2] and (a[1] == b[1] or (met(a[1], b[1]) or codes[a[1]] == codes[b[1]]) and plain_jaro_winkler(a[1], b[1]) >= 0.85)
    }
    df = spark.createDataFrame([*rows, ("9998", "", "A"), ("9999", None, "A")], "id string, name string, country string")
    for rows_per_tile in (4, 2048):
        kept = {r["id"] for r in dedup_fuzzy(df, passes=name_passes, rows_per_tile=rows_per_tile).collect()}
        assert kept == {r[0] for r in rows} - dropped | {"9998", "9999"}


def test_fuzzy_dedup_compares_all_names_of_a_block(spark):
    random.seed(8)
    people = [f"{random.choice(['peter', 'hanna', 'tomas', 'birgit'])} {random.choice(['hansen', 'larsen', 'kowalski', 'dubois'])}" for _ in range(60)]
    bent = []
    for name in people:
        i = random.choice([k for k, c in enumerate(name) if c not in "aeiou "])
        bent.append(name[:i] + random.choice("bdfgklmnprstvz") + name[i + 1 :])
    rows = [(f"{i:04d}", name, "A") for i, name in enumerate(["peter hansen", "peter hamsen", *people, *bent])]
    dropped = {b[0] for a, b in itertools.combinations(rows, 2) if a[1] == b[1] or plain_jaro_winkler(a[1], b[1]) >= 0.85}
    df = spark.createDataFrame(rows, "id string, name string, country string")
    for rows_per_tile in (4, 2048):
        assert {r["id"] for r in dedup_fuzzy(df, rows_per_tile=rows_per_tile).collect()} == {r[0] for r in rows} - dropped
    assert "0001" in dropped


def test_tenants_do_not_mix(spark):
    df = spark.createDataFrame([("t1", "1", "Ann Berg", "a@x"), ("t2", "2", "Ann Berg", "a@x"), ("t2", "3", "Ann Barg", "b@x")], "tenant_id string, id string, name string, email string").withColumn("country", F.lit("NO"))
    assert dedup_exact(df, ["tenant_id", "email"]).count() == 3
    assert {r["id"] for r in dedup_fuzzy(df, block=["tenant_id", "country"]).collect()} == {"1", "2"}
    pairs = spark.createDataFrame([("t1", "1", "2"), ("t2", "1", "2")], "tenant_id string, id_a string, id_b string")
    assert [r["tenant_id"] for r in drop_decided(pairs, pairs.filter("tenant_id = 't1'").select("tenant_id", F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))).collect()] == ["t2"]


def _people(spark, n=240):
    random.seed(11)
    names = _names(40, 4)
    rows = []
    for i in range(n):
        dob = random.choice([None, "", f"19{random.randint(50, 59)}-01-0{random.randint(1, 3)}"])
        rows.append((f"{i:04d}", "t", random.choice(names), dob, random.choice([None, f"{random.choice(names)}@x.org"]), f"b{i % 3}"))
    rows += [("9000", "t", "anna", None, None, "hot"), ("9001", "t", "anna", None, None, "hot"), ("9002", "t", None, None, None, "hot"), ("9003", "t", None, None, None, "hot")]
    return spark.createDataFrame(rows, "id string, tenant_id string, name string, dob string, email string, block_key string")


def test_links_do_not_depend_on_the_tiles(spark):
    people = _people(spark)
    profs = blocking.stored_profiles(people, ["name", "dob", "email"])
    result = []
    for rows_per_tile in (4, 100000):
        spec = MatchSpec(rows_per_tile=rows_per_tile)
        linked = materialize(linked_pairs(profs, spec))
        rows = sorted((r["id_a"], r["id_b"], r["confidence_score"], r["record_pairs"]) for r in linked.collect())
        counts = {r["decision"]: r["pairs"] for r in decision_counts(people, profs, linked, spec).collect()}
        result.append((rows, counts))
    assert result[0] == result[1] and len(result[0][0]) > 20
    total = sum(r["records"] * (r["records"] - 1) // 2 for r in blocking.block_statistics(people).collect())
    assert sum(result[0][1].values()) == total


def test_links_are_those_of_all_pairs_of_a_block(spark):
    people = [("1", "Jon Smith", None, None), ("2", "John Smith", None, None), ("3", "Jon Smith", "1971-05-06", "john.smith@x.org"), ("4", "John Smith", "1971-11-06", "j.smith@x.org")]
    rows = [(i, "t", n, d, m, "b") for i, n, d, m in people] + [(f"5{i:02d}", "t", n, None, None, "c") for i, n in enumerate(_names(60, 21))]
    df = spark.createDataFrame(rows, "id string, tenant_id string, name string, dob string, email string, block_key string")
    profs = blocking.stored_profiles(df, ["name", "dob", "email"])
    wanted = {("1", "2")} | {
        (a[0], b[0]) for a, b in itertools.combinations([r for r in rows if r[5] == "c"], 2) if round(plain_jaro_winkler(a[2], b[2]), 4) >= 0.7
    }
    for rows_per_tile in (4, 2048):
        found = {(r["id_a"], r["id_b"]) for r in linked_pairs(profs, MatchSpec(rows_per_tile=rows_per_tile)).collect()}
        assert ("3", "4") in found and {p for p in found if not {"3", "4"} & set(p)} == wanted


def test_resolve_end_to_end(spark):
    out = resolve(_people(spark))
    clusters = {r["id"]: r["cluster_id"] for r in out.clusters.collect()}
    assert clusters["9000"] == clusters["9001"] == "9000"
    assert clusters["9002"] == "9002" and clusters["9003"] == "9003"  # nothing to compare: no match
    assert out.golden.count() == len(set(clusters.values())) and out.members.count() == len(clusters)
    values = {(r["cluster_id"], r["name"]) for r in out.clusters.collect()}
    assert all((g["cluster_id"], g["name"]) in values for g in out.golden.collect() if g["name"])
    named = out.golden.filter("name <> ''").count()
    assert out.provenance.filter("attribute_name = 'name'").count() == named


def test_decided_pairs_are_not_proposed_again(spark):
    people = _people(spark)
    profs = blocking.stored_profiles(people, ["name", "dob", "email"])
    first = materialize(linked_pairs(profs))
    assert linked_pairs(profs, decided=first.select("tenant_id", F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))).count() == 0


def test_golden_records_and_provenance(spark):
    rows = [("1", "c1", "Lena", "DE", None, None, "src-a"), ("2", "c1", "Lena Vogt", None, "lena@mail.test", None, "src-b"),
            ("3", "c2", "Before", None, None, "2019-07-01", "src-a"), ("4", "c2", "After", None, None, "2022-02-03", None), ("5", "c3", "Bo", " ", "", None, "s"), ("6", "c3", "Al", " ", "", None, "s")]
    records = spark.createDataFrame(rows, "id string, cluster_id string, name string, country string, email string, joined_at string, source_id string").withColumn("tenant_id", F.lit("acme"))
    made = golden.golden_records(records)
    by = {r["cluster_id"]: r for r in made.collect()}
    assert (by["c1"]["name"], by["c1"]["country"], by["c1"]["email"], by["c1"]["cluster_size"]) == ("Lena Vogt", "DE", "lena@mail.test", 2)
    assert by["c2"]["name"] == "After"
    assert by["c3"]["name"] == "Bo" and by["c3"]["country"] is None  # a tie goes to the smallest id, blanks never win
    traced = {(r["golden_id"], r["attribute_name"]): (r["source_record_id"], r["source_id"]) for r in golden.field_provenance(made, records, ["name", "country", "email"]).collect()}
    assert traced[(by["c1"]["golden_id"], "name")] == ("2", "src-b") and traced[(by["c1"]["golden_id"], "country")] == ("1", "src-a")
    assert traced[(by["c2"]["golden_id"], "name")] == ("4", "unknown") and len(traced) == 5
    assert golden.golden_members(records).count() == 6


def test_a_cluster_of_any_size_keeps_its_members(spark):
    records = spark.range(100_000).select(F.col("id").cast("string"), F.lit("t").alias("tenant_id"), F.lit("c").alias("cluster_id"), F.lit("x").alias("name"))
    row = golden.golden_records(records).first()
    assert row["cluster_size"] == 100_000 and golden.golden_members(records).select("source_record_id").distinct().count() == 100_000


def test_blanks_can_count_as_missing(spark):
    rows = [("1", "t", "", "", "ann@x.org", "b"), ("2", "t", " ", None, "bob@y.net", "b"), ("3", "t", "", "", "", "b"), ("4", "t", "", "", "", "b")]
    people = spark.createDataFrame(rows, "id string, tenant_id string, name string, dob string, email string, block_key string")
    of = lambda spec: {r["id"]: r["cluster_id"] for r in resolve(people, spec).clusters.collect()}
    assert of(MatchSpec(blank_as_null=False))["4"] == "3"
    assert of(MatchSpec()) == {"1": "1", "2": "2", "3": "3", "4": "4"}
