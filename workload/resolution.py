"""Blocking, comparison, decisions, clusters, golden records, provenance, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions.text import jaro_winkler, levenshtein_distance, levenshtein_similarity, metaphone, register_sql_functions
from kinfold.operators import blocking, cluster, compare, golden, matching, review
from kinfold.plans.resolution import MatchSpec, assign_clusters, copies, decision_counts, drop_decided, linked_pairs, matched_pairs
from kinfold.session import materialize, scratch_path
from kinfold.sinks import events as out_events
from kinfold.sinks import tables

from . import views as v
from .registry import register
from .views import CLEANED, DUCK, KEYED, SQL_CODE, cleaned, load

ATTRIBUTES = ("name", "dob", "email")
SPEC = MatchSpec()
AT = "2026-01-01 00:00:00"


def keyed(spark, folder):
    return blocking.with_block_key(cleaned(spark, folder))


def profiles(spark, folder):
    return blocking.stored_profiles(keyed(spark, folder), ATTRIBUTES)


def pairs(spark, folder):
    return blocking.candidate_pairs(profiles(spark, folder), ATTRIBUTES)


# every record pair that shares a block, built one by one: the twin does not know about profiles
_PLAIN = "nullif(lower(trim(name)), '') AS nm, nullif(lower(trim(dob)), '') AS db, nullif(lower(trim(email)), '') AS em"
REC = f"""rec AS (SELECT *, min(id) OVER (PARTITION BY tenant_id, block_key, nm, db, em) AS pid FROM (SELECT *, {_PLAIN} FROM ({KEYED})))"""
_JW = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 ELSE jaro_winkler_similarity({a}, {b}) END"
_LEV = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 ELSE 1.0 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"
S_NAME, S_DOB, S_EMAIL = _JW.format(a="a.nm", b="b.nm"), _LEV.format(a="a.db", b="b.db"), _JW.format(a="a.em", b="b.em")


def _mean(*terms: tuple[float, str, str]) -> str:
    """Weighted mean of the scores whose value is present on one side at least."""
    weight = " + ".join(f"CASE WHEN {on} THEN {w}::DOUBLE ELSE 0.0 END" for w, _, on in terms)
    part = " + ".join(f"CASE WHEN {on} THEN {w}::DOUBLE * {score} ELSE 0.0 END" for w, score, on in terms)
    return f"coalesce(round(({part}) / nullif({weight}, 0.0), 4), 0.0)"


SCORED = f"""{REC}, scored AS (SELECT *, {_mean((0.5, "s_name", "has_name"), (0.2, "s_dob", "has_dob"), (0.3, "s_email", "has_email"))} AS score FROM (
  SELECT a.tenant_id AS tenant_id, a.block_key AS block_key, a.id AS id_a, b.id AS id_b, a.pid AS pid_a, b.pid AS pid_b,
    {S_NAME} AS s_name, {S_DOB} AS s_dob, {S_EMAIL} AS s_email, coalesce(a.nm, b.nm) IS NOT NULL AS has_name, coalesce(a.db, b.db) IS NOT NULL AS has_dob,
    coalesce(a.em, b.em) IS NOT NULL AS has_email
  FROM rec a JOIN rec b ON a.tenant_id = b.tenant_id AND a.block_key = b.block_key AND a.id < b.id)),
decided AS (SELECT *, CASE WHEN score >= 0.9 THEN 'match' WHEN score >= 0.7 THEN 'review' ELSE 'non_match' END AS decision FROM scored),
profile_pairs AS (SELECT tenant_id, least(pid_a, pid_b) AS id_a, greatest(pid_a, pid_b) AS id_b, any_value(s_name) AS s_name, any_value(s_dob) AS s_dob,
  any_value(s_email) AS s_email, any_value(has_name) AS has_name, any_value(has_email) AS has_email, any_value(score) AS score, any_value(decision) AS decision,
  count(*) AS record_pairs FROM decided WHERE pid_a <> pid_b GROUP BY 1, 2, 3)"""
CLUSTERED = f"""{SCORED}, link AS (SELECT id_a AS x, id_b AS y FROM decided WHERE decision = 'match' UNION SELECT id_b, id_a FROM decided WHERE decision = 'match'),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
clustered AS (SELECT rec.*, least(id, coalesce(low, id)) AS cluster_id FROM rec LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) ON x = id)"""
GID = "'gr-' || sha256(tenant_id || ':' || cluster_id)"
GOLDEN_COLUMNS = ("age", "country", "dob", "email", "entity_type", "joined_at", "name", "salary_amount", "salary_currency", "score", "source_id")


def _win(c: str) -> str:
    t = f"trim(CAST({c} AS VARCHAR))"
    return f"first({c} ORDER BY joined_at DESC, length({t}) DESC, id) FILTER (WHERE {c} IS NOT NULL AND {t} <> '') AS {c}"


def _latest(c: str) -> str:
    """A number: where the latest records of a cluster differ in it, the length of its text decides, so the twin writes
    doubles the way Spark does."""
    text = f"CASE WHEN {c} = trunc({c}) THEN {c}::BIGINT::VARCHAR || '.0' ELSE {c}::VARCHAR END"
    return f"first({c} ORDER BY joined_at DESC, length({text}) DESC, id) FILTER (WHERE {c} IS NOT NULL) AS {c}"


GOLDEN = f"""{CLUSTERED}, golden AS (SELECT tenant_id, cluster_id, {GID} AS golden_id, count(*) AS cluster_size,
  {', '.join(_win(c) for c in ('name', 'email', 'country', 'dob', 'entity_type', 'joined_at', 'source_id', 'salary_currency', 'age'))},
  {_latest('score')}, {_latest('salary_amount')}
  FROM clustered GROUP BY tenant_id, cluster_id)"""


# ---------------------------------------------------------------- blocking


@register("B1_block_key_parts", f"SELECT id, {SQL_CODE} AS code FROM ({CLEANED})")
def b1(spark, folder):
    return cleaned(spark, folder).select("id", metaphone(F.col("name")).alias("code"))


@register("B2_block_keys", f"SELECT id, tenant_id, block_key FROM ({KEYED})")
def b2(spark, folder):
    return keyed(spark, folder).select("id", "tenant_id", "block_key")


@register("B3_candidate_pairs", f"WITH {SCORED} SELECT tenant_id, id_a, id_b, record_pairs FROM profile_pairs")
def b3(spark, folder):
    return pairs(spark, folder).select("tenant_id", "id_a", "id_b", "record_pairs")


@register(
    "B3_profiles",
    f"WITH {REC} SELECT tenant_id, block_key, nm AS name, db AS dob, em AS email, min(id) AS profile_id, count(*) AS n_records FROM rec GROUP BY 1, 2, 3, 4, 5",
)
def b3p(spark, folder):
    return profiles(spark, folder)


@register(
    "B4_blocking_reduction",
    f"""SELECT tenant_id, records, pairs, 1.0 - pairs / (records * (records - 1) / 2) AS reduction_ratio FROM (
    SELECT tenant_id, sum(n)::BIGINT AS records, sum(n * (n - 1) // 2)::BIGINT AS pairs FROM (
    SELECT tenant_id, block_key, count(*) AS n FROM ({KEYED}) GROUP BY 1, 2) GROUP BY 1)""",
)
def b4(spark, folder):
    return blocking.blocking_reduction(keyed(spark, folder))


@register("D10_prefix_block_key", f"SELECT id, substr(lower(trim(name)), 1, 3) || '_' || upper(trim(country)) AS block_key FROM ({CLEANED})")
def d10(spark, folder):
    return blocking.with_prefix_block_key(cleaned(spark, folder)).select("id", "block_key")


# ---------------------------------------------------------------- comparison and decisions

_PAIR_TEXT = f"""WITH {SCORED}, p AS (SELECT q.id_a, q.id_b, a.nm AS name_a, b.nm AS name_b, a.db AS dob_a, b.db AS dob_b
FROM profile_pairs q JOIN rec a ON a.id = q.id_a JOIN rec b ON b.id = q.id_b)"""


@register("E1_levenshtein_distance", f"{_PAIR_TEXT} SELECT id_a, id_b, levenshtein(coalesce(name_a, ''), coalesce(name_b, '')) AS distance FROM p")
def e1(spark, folder):
    return pairs(spark, folder).select("id_a", "id_b", levenshtein_distance(F.col("name_a"), F.col("name_b")).alias("distance"))


@register("E2_jaro_winkler", f"WITH {SCORED} SELECT id_a, id_b, round(s_name, 6) AS similarity FROM profile_pairs")
def e2(spark, folder):
    return pairs(spark, folder).select("id_a", "id_b", F.round(jaro_winkler(F.col("name_a"), F.col("name_b")), 6).alias("similarity"))


@register("E3_levenshtein_similarity", f"WITH {SCORED} SELECT id_a, id_b, round(s_dob, 6) AS similarity FROM profile_pairs")
def e3(spark, folder):
    return pairs(spark, folder).select("id_a", "id_b", F.round(levenshtein_similarity(F.col("dob_a"), F.col("dob_b")), 6).alias("similarity"))


@register(
    "E4_weighted_scores",
    f"""WITH {SCORED} SELECT id_a, id_b, round(s_name, 4) AS score_name, round(s_email, 4) AS score_email,
    {_mean((0.1, "s_name", "has_name"), (0.9, "s_email", "has_email"))} AS confidence_score FROM profile_pairs""",
)
def e4(spark, folder):
    return compare.score_pairs(pairs(spark, folder), {"name": 0.1, "email": 0.9}, normalized=True).select("id_a", "id_b", "score_name", "score_email", "confidence_score")


@register(
    "E5_compare_pairs",
    f"WITH {SCORED} SELECT id_a, id_b, round(s_name, 4) AS score_name, round(s_dob, 4) AS score_dob, round(s_email, 4) AS score_email, score AS confidence_score FROM profile_pairs",
)
def e5(spark, folder):
    return compare.score_pairs(pairs(spark, folder), normalized=True).select("id_a", "id_b", "score_name", "score_dob", "score_email", "confidence_score")


@register("E6_decisions", f"WITH {SCORED} SELECT id_a, id_b, score AS confidence_score, decision FROM profile_pairs")
def e6(spark, folder):
    return compare.with_decision(compare.score_pairs(pairs(spark, folder), normalized=True)).select("id_a", "id_b", "confidence_score", "decision")


@register("E7_classify_pairs", f"WITH {SCORED} SELECT id_a, id_b, decision AS part FROM profile_pairs")
def e7(spark, folder):
    scored = materialize(compare.score_pairs(pairs(spark, folder), normalized=True).select("id_a", "id_b", "confidence_score"))  # three branches read it
    match, rev, non = compare.classify_pairs(scored)
    part = lambda df, name: df.select("id_a", "id_b", F.lit(name).alias("part"))
    return part(match, "match").unionByName(part(rev, "review")).unionByName(part(non, "non_match"))


@register(
    "A9_decision_counts",
    f"""WITH {SCORED}, found AS (SELECT decision, count(*) AS pairs FROM decided WHERE decision <> 'non_match' GROUP BY 1)
    SELECT * FROM found UNION ALL SELECT 'non_match', (SELECT sum(n * (n - 1) // 2)::BIGINT FROM (SELECT count(*) AS n FROM rec GROUP BY tenant_id, block_key)) - (SELECT sum(pairs)::BIGINT FROM found)""",
)
def a9(spark, folder):
    records, profs = keyed(spark, folder), profiles(spark, folder)
    return decision_counts(records, profs, linked_pairs(profs, SPEC), SPEC)


@register(
    "A9_linked_summary",
    f"WITH {SCORED} SELECT decision, sum(record_pairs)::BIGINT AS pairs, round(sum(score * record_pairs) / sum(record_pairs), 4) AS avg_score FROM profile_pairs WHERE score >= 0.7 GROUP BY 1",
)
def a9b(spark, folder):
    return compare.decision_summary(linked_pairs(profiles(spark, folder), SPEC), "record_pairs")


@register(
    "E7_linked_pairs",
    f"WITH {SCORED} SELECT tenant_id, id_a, id_b, score AS confidence_score, decision, record_pairs FROM profile_pairs WHERE score >= 0.7",
)
def linked(spark, folder):
    return linked_pairs(profiles(spark, folder), SPEC).select("tenant_id", "id_a", "id_b", "confidence_score", "decision", "record_pairs")


@register(
    "E7_copies",
    f"""WITH {REC} SELECT pid AS profile_id, CASE WHEN any_value(coalesce(nm, db, em)) IS NULL THEN 0.0 ELSE 1.0 END AS confidence_score,
    CASE WHEN any_value(coalesce(nm, db, em)) IS NULL THEN 'non_match' ELSE 'match' END AS decision, count(*) * (count(*) - 1) // 2 AS record_pairs FROM rec GROUP BY 1 HAVING count(*) > 1""",
)
def inside(spark, folder):
    return copies(profiles(spark, folder), SPEC).select("profile_id", "confidence_score", "decision", "record_pairs")


# one large block per tenant and country, blanks and all
COARSE = MatchSpec(weights={"name": 0.5, "email": 0.5})


def _coarse(spark, folder):
    return blocking.stored_profiles(cleaned(spark, folder).withColumn("block_key", F.col("country")), ["name", "email"])


@register(
    "E7_linked_pairs_large_blocks",
    f"""WITH r AS (SELECT tenant_id, country, nm, em, min(id) AS id, count(*) AS n FROM (SELECT *, {_PLAIN} FROM ({CLEANED})) GROUP BY 1, 2, 3, 4)
    SELECT tenant_id, id_a, id_b, record_pairs, {_mean((0.5, "s_name", "has_name"), (0.5, "s_email", "has_email"))} AS confidence_score FROM (
    SELECT a.tenant_id, a.id AS id_a, b.id AS id_b, a.n * b.n AS record_pairs, {S_NAME} AS s_name, {S_EMAIL} AS s_email,
      coalesce(a.nm, b.nm) IS NOT NULL AS has_name, coalesce(a.em, b.em) IS NOT NULL AS has_email
    FROM r a JOIN r b ON a.tenant_id = b.tenant_id AND a.country = b.country AND a.id < b.id) WHERE confidence_score >= 0.7""",
)
def linked_large(spark, folder):
    return linked_pairs(_coarse(spark, folder), COARSE).select("tenant_id", "id_a", "id_b", "record_pairs", "confidence_score")


@register("R6_drop_decided", f"""WITH {SCORED}, both_tenants AS (SELECT tenant_id, id_a, id_b, s_dob FROM profile_pairs WHERE score >= 0.7
    UNION ALL SELECT 'other', id_a, id_b, s_dob FROM profile_pairs WHERE score >= 0.7)
    SELECT tenant_id, id_a, id_b FROM both_tenants WHERE s_dob <> 1.0 OR tenant_id = 'other'""")
def r6(spark, folder):
    found = materialize(linked_pairs(profiles(spark, folder), SPEC).select("tenant_id", "id_a", "id_b", "score_dob"))
    decided = found.filter("score_dob = 1.0").select("tenant_id", F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))
    both = found.unionByName(found.withColumn("tenant_id", F.lit("other")))
    return drop_decided(both, decided).select("tenant_id", "id_a", "id_b")


@register(
    "V1_sql_functions",
    f"""WITH {SCORED} SELECT q.id_a, q.id_b, round(s_name, 6) AS jw, round(s_dob, 6) AS lev, CASE WHEN a.nm IS NULL THEN '' ELSE split_part(a.block_key, '_', 1) END AS code
    FROM profile_pairs q JOIN rec a ON a.id = q.id_a""",
)
def v1(spark, folder):
    register_sql_functions(spark)
    return pairs(spark, folder).selectExpr(
        "id_a", "id_b", "round(jaro_winkler(name_a, name_b), 6) AS jw", "round(levenshtein_similarity(dob_a, dob_b), 6) AS lev", "coalesce(metaphone(name_a), '') AS code"
    )


@register("D11_tfidf_cosine", f"""WITH {SCORED}, doc AS (SELECT DISTINCT pid AS id, nm FROM rec WHERE id = pid),
tok AS (SELECT id, t AS token, count(*) AS tf FROM (SELECT id, unnest(list_filter(regexp_split_to_array(nm, '[^a-z0-9]+'), lambda x : x <> '')) AS t FROM doc) GROUP BY 1, 2),
idf AS (SELECT token, ln(((SELECT count(*) FROM doc) + 1.0) / (count(*) + 1.0)) + 1.0 AS w FROM tok GROUP BY 1),
vec AS (SELECT id, token, tf * w / sqrt(sum(tf * w * tf * w) OVER (PARTITION BY id)) AS w FROM tok JOIN idf USING (token))
SELECT p.id_a, p.id_b, round(coalesce(sum(a.w * b.w), 0.0), 4) AS tfidf_cosine FROM profile_pairs p LEFT JOIN vec a ON a.id = p.id_a
LEFT JOIN vec b ON b.id = p.id_b AND b.token = a.token GROUP BY 1, 2""")
def d11(spark, folder):
    from kinfold.operators.search import tfidf_cosine, token_weights, with_vectors

    profs = profiles(spark, folder)
    vectors = materialize(with_vectors(profs, token_weights(profs, "profile_id", "name"), "profile_id").drop(*ATTRIBUTES), "profile_id")
    return tfidf_cosine(blocking.candidate_pairs(vectors, ["vector"])).select("id_a", "id_b", "tfidf_cosine")


_BAGS = f"""bag AS (SELECT id, tenant_id, list_sort(list_filter(regexp_split_to_array(lower(name || ' ' || email), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM ({CLEANED})),
member AS (SELECT id, tenant_id, w, CASE WHEN len(w) > 0 THEN min(id) OVER (PARTITION BY tenant_id, w) ELSE id END AS class_id FROM bag),
tok AS (SELECT id, tenant_id, token, count(*)::DOUBLE AS tf FROM (SELECT id, tenant_id, unnest(w) AS token FROM member WHERE id = class_id) GROUP BY 1, 2, 3),
idf AS (SELECT token, ln(((SELECT count(*) FROM member WHERE id = class_id) + 1.0) / (count(*) + 1.0)) + 1.0 AS v FROM tok GROUP BY 1),
vec AS (SELECT id, tenant_id, token, tf * v / sqrt(sum(tf * v * tf * v) OVER (PARTITION BY id)) AS v FROM tok JOIN idf USING (token)),
linked AS (SELECT a.id AS id_a, b.id AS id_b, round(sum(a.v * b.v), 4) AS cosine FROM vec a JOIN vec b ON a.tenant_id = b.tenant_id AND a.token = b.token AND a.id < b.id
  GROUP BY 1, 2 HAVING round(sum(a.v * b.v), 4) >= 0.7)"""


def names_and_mails(spark, folder):
    texts = cleaned(spark, folder).withColumn("text", F.concat_ws(" ", "name", "email"))
    return matching.cosine_join(texts, "id", "text", 0.7, ["tenant_id"])


@register("D11_cosine_join", f"WITH {_BAGS} SELECT id_a, id_b, cosine FROM linked")
def cosine_join(spark, folder):
    return names_and_mails(spark, folder)[0]


@register("D11_cosine_links", f"""WITH {_BAGS}, ends AS (SELECT id_a AS class_id FROM linked UNION ALL SELECT id_b FROM linked)
SELECT id, class_id, (SELECT count(*) FROM ends e WHERE e.class_id = member.class_id) AS n_links FROM member""")
def cosine_links(spark, folder):
    return matching.link_counts(*names_and_mails(spark, folder))


@register("D11_identifier_links", f"""WITH held AS (SELECT tenant_id, 'email' AS identifier, id, email AS value FROM ({CLEANED}) WHERE email <> ''
  UNION ALL SELECT tenant_id, 'name', id, lower(name) FROM ({CLEANED}) WHERE trim(name) <> ''),
first AS (SELECT *, min(id) OVER (PARTITION BY tenant_id, identifier, value) AS id_a, count(*) OVER (PARTITION BY tenant_id, identifier, value) AS holders FROM held)
SELECT tenant_id, identifier, id_a, id AS id_b, holders FROM first WHERE holders > 1 AND id <> id_a""")
def identifier_links(spark, folder):
    return matching.identifier_links(cleaned(spark, folder), ["email", "name"])


# ---------------------------------------------------------------- clusters, golden records, provenance


def clustered(spark, folder):
    return assign_clusters(cleaned(spark, folder), SPEC)[0]


@register(
    "G1_connected_components",
    f"WITH RECURSIVE {CLUSTERED} SELECT DISTINCT pid AS id, cluster_id FROM clustered WHERE pid IN (SELECT id_a FROM profile_pairs WHERE decision = 'match' UNION SELECT id_b FROM profile_pairs WHERE decision = 'match')",
)
def g1(spark, folder):
    return cluster.connected_components(matched_pairs(profiles(spark, folder), SPEC), scope=["tenant_id"]).select("id", "cluster_id")


@register("G2_clusters", f"WITH RECURSIVE {CLUSTERED} SELECT tenant_id, id, cluster_id FROM clustered")
def g2(spark, folder):
    return clustered(spark, folder).select("tenant_id", "id", "cluster_id")


_GOLDEN_OUT = "golden_id, cluster_id, cluster_size, name, email, country, dob, entity_type, joined_at, source_id, salary_currency, age, score, salary_amount"


@register("G3_golden_records", f"WITH RECURSIVE {GOLDEN} SELECT {_GOLDEN_OUT} FROM golden")
def g3(spark, folder):
    return golden.golden_records(clustered(spark, folder)).select(*_GOLDEN_OUT.split(", "))


@register("G4_golden_heads", f"WITH RECURSIVE {GOLDEN} SELECT golden_id, tenant_id, cluster_size FROM golden")
def g4(spark, folder):
    return golden.golden_records(clustered(spark, folder)).select("golden_id", "tenant_id", "cluster_size")


@register("G4_golden_members", f"WITH RECURSIVE {CLUSTERED} SELECT {GID} AS golden_id, tenant_id, id AS source_record_id FROM clustered")
def g4m(spark, folder):
    return golden.golden_members(clustered(spark, folder))


_TRACED = ["country", "dob", "email", "entity_type", "joined_at", "name", "salary_currency"]
_PROVENANCE = " UNION ALL ".join(
    f"""SELECT g.golden_id, '{c}' AS attribute_name, trim(g.{c}) AS attribute_value, first(r.id ORDER BY r.id) AS source_record_id,
    first(r.source_id ORDER BY r.id) AS source_id, 1.0::DOUBLE AS confidence_score FROM golden g JOIN clustered r ON r.tenant_id = g.tenant_id
    AND r.cluster_id = g.cluster_id AND trim(r.{c}) = trim(g.{c}) WHERE trim(g.{c}) <> '' GROUP BY 1, 2, 3"""
    for c in _TRACED
)


@register("G5_field_provenance", f"WITH RECURSIVE {GOLDEN} {_PROVENANCE}")
def g5(spark, folder):
    rows = clustered(spark, folder)
    traced = golden.field_provenance(golden.golden_records(rows), rows, _TRACED)
    return traced.select("golden_id", "attribute_name", "attribute_value", "source_record_id", "source_id", "confidence_score")


# ---------------------------------------------------------------- result tables and events


@register(
    "K3_review_candidates",
    f"""WITH {SCORED} SELECT sha256(tenant_id || ':' || id_a || ':' || id_b) AS id, tenant_id, id_a AS record_id_a, id_b AS record_id_b, score AS confidence_score,
    'PENDING' AS status, decision AS payload_decision FROM profile_pairs WHERE decision = 'review'""",
)
def k3(spark, folder):
    path = scratch_path(spark, "er_candidates")
    found = linked_pairs(profiles(spark, folder), SPEC).filter("decision = 'review'")
    tables.write_counted(tables.review_candidates(found, F.col("tenant_id"), F.lit(AT).cast("timestamp")), path)
    stored = spark.read.parquet(path)
    return stored.select("id", "tenant_id", "record_id_a", "record_id_b", "confidence_score", "status", F.get_json_object("payload", "$.decision").alias("payload_decision"))


@register(
    "K4_golden_rows",
    f"WITH RECURSIVE {GOLDEN} SELECT golden_id, tenant_id, cluster_size, name, email, CAST(age AS VARCHAR) AS age FROM golden",
)
def k4(spark, folder):
    path = scratch_path(spark, "golden_records")
    tables.write_counted(tables.golden_rows(golden.golden_records(clustered(spark, folder)), F.lit(AT).cast("timestamp")), path, ["tenant_id"])
    field = lambda c: F.get_json_object("attributes", f"$.{c}").alias(c)
    return spark.read.parquet(path).select("golden_id", "tenant_id", "cluster_size", field("name"), field("email"), field("age"))


@register(
    "K5_provenance_rows",
    f"WITH RECURSIVE {GOLDEN} SELECT sha256(golden_id || ':' || attribute_name) AS id, golden_id, attribute_name, source_record_id, source_id, confidence_score FROM ({_PROVENANCE})",
)
def k5(spark, folder):
    path = scratch_path(spark, "provenance")
    rows = clustered(spark, folder)
    traced = golden.field_provenance(golden.golden_records(rows), rows, _TRACED, created_at=F.lit(AT).cast("timestamp"))
    tables.write_counted(tables.provenance_rows(traced), path)
    return spark.read.parquet(path).select("id", "golden_id", "attribute_name", "source_record_id", "source_id", "confidence_score")


@register(
    "K7_entity_resolved_events",
    f"WITH RECURSIVE {GOLDEN} SELECT tenant_id || ':' || golden_id AS key, tenant_id, golden_id, 'Person' AS entity_type, name, email FROM golden",
)
def k7(spark, folder):
    sent = out_events.entity_resolved_events(golden.golden_records(clustered(spark, folder)), F.lit("Person"))
    field = lambda path, name: F.get_json_object("value", path).alias(name)
    return sent.select(
        "key", field("$.tenant_id", "tenant_id"), field("$.golden_id", "golden_id"), field("$.entity_type", "entity_type"), field("$.data.name", "name"), field("$.data.email", "email")
    )


# ---------------------------------------------------------------- review


def candidates(spark, folder):
    snapshot = F.map_from_arrays(F.array(F.lit("priority"), F.lit("phone"), F.lit("city")), F.array("b_priority", "b_phone", "b_city"))
    return load(spark, folder, v.candidates).withColumn("record_b_snapshot", snapshot).drop("b_priority", "b_phone", "b_city")


def golden_state(spark, folder):
    state = F.map_from_arrays(F.array(F.lit("priority"), F.lit("phone"), F.lit("segment")), F.array("g_priority", "g_phone", "g_segment"))
    return load(spark, folder, v.golden_state).withColumn("properties", state).drop("g_priority", "g_phone", "g_segment")


def members(spark, folder):
    return golden_state(spark, folder).select("golden_id", "tenant_id", F.concat(F.lit("a"), F.substring("golden_id", 4, 20)).alias("source_record_id"))


def decide(spark, folder):
    return review.apply_decisions(load(spark, folder, v.decisions), candidates(spark, folder), golden_state(spark, folder), members(spark, folder))


_JUDGED = f"""cand AS ({v.candidates(DUCK)}), gold AS ({v.golden_state(DUCK)}),
judged AS (SELECT d.*, c.status, c.golden_record_id, c.record_b_id, c.b_priority, c.b_phone, c.b_city,
  row_number() OVER (PARTITION BY d.candidate_id ORDER BY d.decided_at, d.decision) AS r,
  first_value(d.decision) OVER (PARTITION BY d.candidate_id ORDER BY d.decided_at, d.decision) AS first_decision
  FROM ({v.decisions(DUCK)}) d LEFT JOIN cand c ON c.id = d.candidate_id),
ok AS (SELECT * FROM judged WHERE status = 'PENDING' AND r = 1),
acc AS (SELECT * FROM ok WHERE decision = 'ACCEPT'),
inc AS (SELECT golden_record_id AS golden_id, candidate_id, record_b_id, decided_at, f.field_name, f.value FROM acc,
  LATERAL (SELECT unnest(['priority', 'phone', 'city']) AS field_name, unnest([b_priority, b_phone, b_city]) AS value) f WHERE trim(f.value) <> ''),
cur AS (SELECT golden_id, 'priority' AS field_name, g_priority AS value FROM gold UNION ALL SELECT golden_id, 'phone', g_phone FROM gold UNION ALL SELECT golden_id, 'segment', g_segment FROM gold),
fin AS (SELECT coalesce(i.golden_id, c.golden_id) AS golden_id, coalesce(i.field_name, c.field_name) AS field_name,
  CASE WHEN c.value IS NULL OR trim(c.value) = '' THEN coalesce(i.value, c.value) ELSE c.value END AS value
  FROM (SELECT golden_id, field_name, first(value ORDER BY decided_at, candidate_id) AS value FROM inc GROUP BY 1, 2) i FULL JOIN cur c ON c.golden_id = i.golden_id AND c.field_name = i.field_name)"""


@register("R1_merge_non_conflicting", f"WITH {_JUDGED} SELECT golden_id, field_name, value FROM fin")
def r1(spark, folder):
    return decide(spark, folder).golden.select("golden_id", F.explode("properties").alias("field_name", "value"))


@register(
    "R1_field_merge_log",
    f"""WITH {_JUDGED} SELECT i.golden_id, i.record_b_id AS source_record_id, i.field_name, i.candidate_id, 'FIELD_MERGE' AS action FROM inc i
    JOIN fin f ON f.golden_id = i.golden_id AND f.field_name = i.field_name AND f.value = i.value
    UNION ALL SELECT golden_record_id, record_b_id, NULL, candidate_id, 'MERGE_ACCEPT' FROM acc""",
)
def r1log(spark, folder):
    return decide(spark, folder).log.select("golden_id", "source_record_id", "field_name", "candidate_id", "action")


@register(
    "R2_accept_members",
    f"WITH {_JUDGED} SELECT golden_id, 'a' || substr(golden_id, 4) AS source_record_id FROM gold UNION SELECT golden_record_id, record_b_id FROM acc",
)
def r2(spark, folder):
    return decide(spark, folder).members.select("golden_id", "source_record_id")


@register("R2_versions", f"WITH {_JUDGED} SELECT golden_id, version + coalesce(n, 0) AS version FROM gold LEFT JOIN (SELECT golden_record_id, count(*) AS n FROM acc GROUP BY 1) ON golden_record_id = golden_id")
def r2v(spark, folder):
    return decide(spark, folder).golden.select("golden_id", "version")


@register(
    "R3_candidate_states",
    f"WITH {_JUDGED} SELECT id, CASE WHEN o.decision = 'ACCEPT' THEN 'ACCEPTED' WHEN o.decision = 'REJECT' THEN 'REJECTED' ELSE c.status END AS status, o.decided_by AS reviewed_by FROM cand c LEFT JOIN ok o ON o.candidate_id = c.id",
)
def r3(spark, folder):
    return decide(spark, folder).candidates.select("id", "status", "reviewed_by")


@register(
    "R5_conflicts",
    f"""WITH {_JUDGED} SELECT candidate_id, decision, CASE WHEN status IS NULL THEN 'candidate not found' WHEN status <> 'PENDING' THEN 'candidate is already ' || status
    ELSE 'candidate is already ' || CASE WHEN first_decision = 'ACCEPT' THEN 'ACCEPTED' ELSE 'REJECTED' END END AS problem FROM judged WHERE status IS NULL OR status <> 'PENDING' OR r > 1""",
)
def r5(spark, folder):
    return review.conflict_report(load(spark, folder, v.decisions), candidates(spark, folder))


@register("K9_entity_updated_events", f"WITH {_JUDGED} SELECT golden_record_id AS key, 'acme' AS tenantId, golden_record_id AS entityId, 'GOLDEN_RECORD_MERGE' AS changeType FROM acc")
def k9(spark, folder):
    sent = out_events.entity_updated_events(decide(spark, folder).events)
    field = lambda c: F.get_json_object("value", f"$.{c}").alias(c)
    return sent.select("key", field("tenantId"), field("entityId"), field("changeType"))


def _orders_of(d) -> str:
    return f"SELECT 'gr-' || cast(o_custkey as string) AS golden_id, 'acme' AS tenant_id, 'o' || cast(o_orderkey as string) AS source_record_id FROM {d.table('orders')}"


def _requests(d) -> str:
    return f"""SELECT 'gr-' || cast(CASE WHEN o_orderkey % 40 = 0 THEN o_custkey + 1 ELSE o_custkey END as string) AS golden_id,
    'o' || cast(o_orderkey as string) AS source_record_id, o_orderdate AS requested_at FROM {d.table('orders')} WHERE o_custkey % 2 = 0 OR o_orderkey % 3 = 0"""


def split(spark, folder):
    own = load(spark, folder, _orders_of)
    state = golden_state(spark, folder)
    return review.apply_splits(load(spark, folder, _requests), state, own)


_SPLITS = f"""gold AS ({v.golden_state(DUCK)}), mem AS ({_orders_of(DUCK)}), req AS ({_requests(DUCK)}), size AS (SELECT golden_id, count(*) AS n FROM mem GROUP BY 1),
known AS (SELECT r.*, m.golden_id IS NOT NULL AS is_member, s.n FROM req r LEFT JOIN mem m ON m.golden_id = r.golden_id AND m.source_record_id = r.source_record_id LEFT JOIN size s ON s.golden_id = r.golden_id),
turn AS (SELECT *, row_number() OVER (PARTITION BY golden_id, is_member ORDER BY requested_at, source_record_id) AS t FROM known),
done AS (SELECT *, 'gr-' || sha256(golden_id || ':' || source_record_id) AS fresh FROM turn WHERE is_member AND t < n)"""


@register("R4_split_members", f"WITH {_SPLITS} SELECT golden_id, source_record_id FROM mem WHERE source_record_id NOT IN (SELECT source_record_id FROM done) UNION ALL SELECT fresh, source_record_id FROM done")
def r4(spark, folder):
    return split(spark, folder).members.select("golden_id", "source_record_id")


@register("R4_split_golden", f"""WITH {_SPLITS} SELECT g.golden_id, version + (SELECT count(*) FROM done d WHERE d.golden_id = g.golden_id) AS version, g_segment AS segment FROM gold g
UNION ALL SELECT fresh, 0, g_segment FROM done d JOIN gold g ON g.golden_id = d.golden_id""")
def r4g(spark, folder):
    return split(spark, folder).golden.select("golden_id", "version", F.col("properties")["segment"].alias("segment"))


@register(
    "R4_split_conflicts",
    f"""WITH {_SPLITS} SELECT golden_id, source_record_id, CASE WHEN n IS NULL THEN 'golden record not found' WHEN NOT is_member THEN 'source record is not part of golden record'
    ELSE 'golden record has only one source record' END AS problem FROM turn WHERE n IS NULL OR NOT is_member OR t >= n""",
)
def r4c(spark, folder):
    return split(spark, folder).conflicts


@register("R4_split_log", f"WITH {_SPLITS} SELECT golden_id, source_record_id, 'SPLIT_REMOVE' AS action FROM done UNION ALL SELECT fresh, source_record_id, 'SPLIT_CREATE' FROM done")
def r4l(spark, folder):
    return split(spark, folder).log.select("golden_id", "source_record_id", "action")


@register("P10_list_candidates", f"SELECT id, golden_record_id, similarity_score, status FROM ({v.candidates(DUCK)}) WHERE status = 'PENDING' ORDER BY similarity_score DESC, id LIMIT 20 OFFSET 40")
def p10(spark, folder):
    from kinfold.operators.paging import page

    listed = review.list_candidates(candidates(spark, folder), "PENDING").select("id", "golden_record_id", "similarity_score", "status")
    return page(listed, 2, 20, [F.col("similarity_score").desc(), "id"])


@register("P11_candidate_detail", f"SELECT id, golden_record_id, record_a_id, record_b_id, comparison_details, b_priority AS priority FROM ({v.candidates(DUCK)}) WHERE id = 'cand-77'")
def p11(spark, folder):
    found = review.candidate_detail(candidates(spark, folder), "cand-77")
    return found.select("id", "golden_record_id", "record_a_id", "record_b_id", "comparison_details", F.col("record_b_snapshot")["priority"].alias("priority"))
