"""Cleaning, de-duplication, validation, inference and mapping."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from kinfold.functions.parse import parse_currency
from kinfold.functions.text import normalize, strip, title_case
from kinfold.operators import anomaly, cleaning, dedup, infer, mapping, quality
from kinfold.operators.analytics import equality_filter, tenant_scope
from kinfold.plans.intake import intake

from . import views as v
from .registry import register
from .views import CLEANED, DUCK, PARTY, cleaned, load, party, sql_amount, sql_currency, sql_date, sql_title

TEXT = ["name", "email", "country", "entity_type", "dob", "joined_at", "salary"]


@register("C1_strip_strings", f"SELECT id, {', '.join(f'trim({c}) AS {c}' for c in TEXT)} FROM ({PARTY})")
def c1(spark, folder):
    return cleaning.strip_strings(load(spark, folder, party)).select("id", *TEXT)


@register("C2_normalize_case", f"SELECT id, {sql_title('trim(name)')} AS name, lower(trim(email)) AS email FROM ({PARTY})")
def c2(spark, folder):
    return cleaning.normalize_case(cleaning.strip_strings(load(spark, folder, party))).select("id", "name", "email")


@register("C3_fill_nulls", f"SELECT id, coalesce(name, '') AS name, coalesce(email, '') AS email, coalesce(age, 0) AS age, coalesce(score, 0.0) AS score FROM ({PARTY})")
def c3(spark, folder):
    return cleaning.fill_nulls(load(spark, folder, party)).select("id", "name", "email", "age", "score")


_ALL = ["id", "tenant_id", "source_id", *TEXT[:5], "joined_at", "age", "score", "salary"]


@register(
    "C4_count_nulls",
    f"SELECT {', '.join(f'count(*) - count({c}) AS {c}' for c in _ALL)}, {' + '.join(f'(count(*) - count({c}))' for c in _ALL)} AS total_nulls FROM ({PARTY})",
)
def c4(spark, folder):
    return cleaning.count_nulls(load(spark, folder, party))


@register("C5_upper_country", f"SELECT id, upper(country) AS country FROM ({PARTY})")
def c5(spark, folder):
    return cleaning.upper_columns(load(spark, folder, party)).select("id", "country")


@register("C6_parse_dates", f"SELECT id, {sql_date('joined_at')} AS joined_at FROM ({PARTY})")
def c6(spark, folder):
    return cleaning.parse_dates(load(spark, folder, party)).select("id", "joined_at")


@register("C7_parse_currencies", f"SELECT id, {sql_amount('salary')} AS salary_amount, {sql_currency('salary')} AS salary_currency FROM ({PARTY})")
def c7(spark, folder):
    return cleaning.parse_currencies(load(spark, folder, party)).select("id", "salary_amount", "salary_currency")


@register("C8_clean", CLEANED)
def c8(spark, folder):
    return cleaned(spark, folder)


@register(
    "C9_clean_light",
    f"""SELECT id, name, email FROM (SELECT id, trim(lower(name)) AS name, trim(lower(email)) AS email,
    row_number() OVER (PARTITION BY trim(lower(email)) ORDER BY id) AS r FROM ({PARTY})) WHERE r = 1 ORDER BY id""",
)
def c9(spark, folder):
    return cleaning.clean_light(load(spark, folder, party).select("id", "name", "email"))


RULES = [
    {"rule_type": "UPPERCASE", "column_name": "country", "priority": 20, "enabled": True, "rule_config": None},
    {"rule_type": "TRIM", "column_name": "country", "priority": 10, "enabled": True, "rule_config": None},
    {"rule_type": "NULL_FILL", "column_name": "country", "priority": 30, "enabled": True, "rule_config": json.dumps({"value": "NOWHERE"})},
    {"rule_type": "REGEX_REPLACE", "column_name": "email", "priority": 40, "enabled": True, "rule_config": json.dumps({"pattern": "@.*$", "replacement": "@hidden"})},
    {"rule_type": "LOWERCASE", "column_name": "email", "priority": 50, "enabled": True, "rule_config": None},
    {"rule_type": "TRIM", "column_name": "email", "priority": 51, "enabled": True, "rule_config": None},
    {"rule_type": "DATE_NORMALIZE", "column_name": "joined_at", "priority": 60, "enabled": True, "rule_config": None},
    {"rule_type": "UPPERCASE", "column_name": "name", "priority": 70, "enabled": False, "rule_config": None},
    {"rule_type": "REMOVE_DUPLICATES", "column_name": "email", "priority": 80, "enabled": True, "rule_config": json.dumps({"subset": ["email", "country"]})},
]


@register(
    "C10_apply_rules",
    f"""SELECT id, name, email, country, joined_at FROM (SELECT *, row_number() OVER (PARTITION BY email, country ORDER BY id) AS r FROM (
    SELECT id, name, trim(lower(regexp_replace(email, '@.*$', '@hidden'))) AS email, coalesce(upper(trim(country)), 'NOWHERE') AS country,
    {sql_date('joined_at')} AS joined_at FROM ({PARTY}))) WHERE r = 1""",
)
def c10(spark, folder):
    return cleaning.apply_rules(load(spark, folder, party), RULES).select("id", "name", "email", "country", "joined_at")


# ---------------------------------------------------------------- de-duplication and validation

EXACT = f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, email ORDER BY id) AS r FROM ({CLEANED})) WHERE r = 1"
FUZZY = f"""WITH x AS ({EXACT}), y AS (SELECT id, tenant_id, country, name FROM x WHERE name <> '')
SELECT * FROM x WHERE id NOT IN (SELECT b.id FROM y a JOIN y b ON a.tenant_id = b.tenant_id AND a.country = b.country AND a.id < b.id
AND jaro_winkler_similarity(a.name, b.name) >= 0.85)"""


@register("X1_dedup_exact", f"SELECT id, email FROM ({EXACT})")
def x1(spark, folder):
    return dedup.dedup_exact(cleaned(spark, folder).select("id", "tenant_id", "email"), ["tenant_id", "email"], "id").select("id", "email")


@register("X2_dedup_fuzzy", f"SELECT id, name, country FROM ({FUZZY})")
def x2(spark, folder):
    exact = dedup.dedup_exact(cleaned(spark, folder), ["tenant_id", "email"], "id")
    return dedup.dedup_fuzzy(exact, block=["tenant_id", "country"]).select("id", "name", "country")


@register(
    "X3_dedup_report",
    f"""SELECT n AS rows_in, e AS after_exact, f AS after_fuzzy, n - e AS removed_exact, e - f AS removed_fuzzy FROM (
    SELECT (SELECT count(*) FROM ({CLEANED})) AS n, (SELECT count(*) FROM ({EXACT})) AS e, (SELECT count(*) FROM ({FUZZY})) AS f)""",
)
def x3(spark, folder):
    done = intake(load(spark, folder, party), ["tenant_id"])
    return dedup.dedup_report(done.cleaned, done.exact, done.fuzzy)


@register(
    "P6_validate",
    f"""SELECT id, id <> '' AS _valid_id, name <> '' AS _valid_name, contains(email, '@') AS _valid_email,
    id <> '' AND name <> '' AND contains(email, '@') AS _is_valid FROM ({CLEANED})""",
)
def p6(spark, folder):
    return quality.with_validity(cleaned(spark, folder)).select("id", *quality.FLAGS, "_is_valid")


@register("intake_valid_rows", f"SELECT id, name, email, joined_at, salary_amount FROM ({FUZZY}) WHERE id <> '' AND name <> '' AND contains(email, '@')")
def intake_valid(spark, folder):
    return intake(load(spark, folder, party), ["tenant_id"]).valid.select("id", "name", "email", "joined_at", "salary_amount")


@register("U2_split_and_recombine", f"SELECT id, name <> '' AND contains(email, '@') AS was_valid FROM ({CLEANED})")
def u2(spark, folder):
    valid, invalid = quality.split_valid(cleaned(spark, folder))
    mark = lambda df, ok: df.select("id", F.lit(ok).alias("was_valid"))
    return quality.recombine(mark(valid, True), mark(invalid, False))


@register(
    "U1_union_by_name",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL AS nation FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier""",
)
def u1(spark, folder):
    c = v.table(spark, folder, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment")
    s = v.table(spark, folder, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_nationkey AS nation", "s_acctbal AS balance")
    return quality.recombine(c, s)


PROPERTY_SCHEMA = {
    "name": {"type": "string", "required": True},
    "email": {"type": "string", "required": True},
    "dob": {"type": "timestamp"},
    "salary": {"type": "float"},
    "entity_type": {"type": "string", "enum": ["person", "organization"]},
}


@register(
    "D8_check_properties",
    f"""SELECT id, list_filter([CASE WHEN coalesce(name, '') = '' THEN 'name:required' END, CASE WHEN coalesce(email, '') = '' THEN 'email:required' END,
    CASE WHEN dob IS NOT NULL AND try_cast(dob AS TIMESTAMP) IS NULL THEN 'dob:type' END,
    CASE WHEN salary IS NOT NULL AND try_cast(trim(salary) AS DOUBLE) IS NULL THEN 'salary:type' END,
    CASE WHEN entity_type IS NOT NULL AND entity_type NOT IN ('person', 'organization') THEN 'entity_type:enum' END], lambda e : e IS NOT NULL) AS errors,
    CASE WHEN coalesce(name, '') = '' OR coalesce(email, '') = '' OR (salary IS NOT NULL AND try_cast(trim(salary) AS DOUBLE) IS NULL)
      OR (dob IS NOT NULL AND try_cast(dob AS TIMESTAMP) IS NULL) OR (entity_type IS NOT NULL AND entity_type NOT IN ('person', 'organization')) THEN 'QUARANTINED' ELSE 'PASSED' END AS status FROM ({PARTY})""",
)
def d8(spark, folder):
    return quality.check_properties(load(spark, folder, party), PROPERTY_SCHEMA).select("id", "errors", "status")


@register(
    "D9_outliers_zscore",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, coalesce(abs(l_extendedprice - m) / nullif(s, 0) > 2.0, false) AS is_outlier
    FROM lineitem JOIN (SELECT l_returnflag AS f, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON f = l_returnflag""",
)
def d9z(spark, folder):
    found = quality.flag_outliers(v.table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag"], "zscore", 2.0)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "is_outlier")


@register(
    "D9_outliers_iqr",
    """SELECT event_id, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false) AS is_outlier FROM events JOIN (
    SELECT event_type AS t, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) ON t = event_type""",
)
def d9i(spark, folder):
    return quality.flag_outliers(v.table(spark, folder, "events"), "value", ["event_type"], "iqr").select("event_id", "is_outlier")


@register(
    "D9_anomalies_by_hour",
    """WITH p AS (SELECT event_type, (floor(epoch(ts) / 21600) * 21600)::BIGINT AS start, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2),
    q AS (SELECT *, start // 86400 AS season, start % 86400 AS place FROM p),
    b AS (SELECT a.event_type, a.start, a.value, x.value AS seen FROM q a LEFT JOIN q x ON x.event_type = a.event_type AND x.place = a.place AND x.season BETWEEN a.season - 14 AND a.season - 1),
    m AS (SELECT *, median(seen) OVER (PARTITION BY event_type, start) AS expected FROM b),
    f AS (SELECT event_type, start, any_value(value) AS value, count(seen) AS n_before, any_value(expected) AS expected, abs(any_value(value) - any_value(expected)) AS away,
      coalesce(nullif(median(abs(seen - expected)) * 1.4826, 0.0), nullif(avg(abs(seen - expected)) * 1.253314, 0.0)) AS spread FROM m GROUP BY 1, 2)
    SELECT event_type, make_timestamp(start * 1000000) AS timestamp, value, n_before, expected, round(away / spread, 4) AS deviation,
      n_before >= 5 AND coalesce(away / spread > 3.5, away > 0, false) AS is_anomaly FROM f""",
)
def d9a(spark, folder):
    events = v.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = anomaly.anomalies(events, "ts", "6h", "count", ["event_type"], "1d", 14)
    return found.withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz"), "deviation": F.round("deviation", 4)})


# ---------------------------------------------------------------- inference

INFER_COLUMNS = ["flag", "whole", "number", "moment", "day", "free", "void", "mixed"]


def _samples(d) -> str:
    return f"""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'FALSE' END AS flag,
    CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE cast(o_orderkey as string) END AS whole, cast(cast(o_totalprice as decimal(18, 2)) as string) AS number,
    substr(cast(o_orderdate as string), 1, 10) || ' 10:30:00' AS moment, substr(cast(o_orderdate as string), 1, 10) AS day,
    o_orderpriority AS free, cast(NULL as string) AS void, CASE WHEN o_orderkey = 5000 THEN 'late text' ELSE cast(o_orderkey % 2 as string) END AS mixed
    FROM {d.table('orders')}"""


def _sql_infer(tests: list[tuple[str, str]], limit: int | None) -> str:
    parts = []
    for c in INFER_COLUMNS:
        take = f"ORDER BY k LIMIT {limit}" if limit else ""
        cases = " ".join(f"WHEN bool_and({t}) THEN '{n}'" for n, t in tests)
        parts.append(
            f"SELECT '{c}' AS \"column\", CASE WHEN count(*) = 0 THEN 'STRING' {cases} ELSE 'STRING' END AS type "
            f"FROM (SELECT trim({c}) AS x FROM ({_samples(DUCK)}) WHERE trim({c}) <> '' {take})"
        )
    return " UNION ALL ".join(parts)


_STAMP = r"regexp_full_match(x, '\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?') AND try_cast(x AS TIMESTAMP) IS NOT NULL"
_BOOL = "lower(x) IN ('true', 'false', '1', '0')"


@register(
    "N1_infer_backend",
    _sql_infer([("INTEGER", r"regexp_full_match(x, '[+-]?\d+')"), ("DOUBLE", "try_cast(x AS DOUBLE) IS NOT NULL"), ("BOOLEAN", _BOOL), ("TIMESTAMP", _STAMP)], 100),
)
def n1(spark, folder):
    return infer.infer_schema(load(spark, folder, _samples), INFER_COLUMNS, "backend", "k")


@register(
    "N2_infer_ui",
    _sql_infer([("BOOLEAN", _BOOL), ("INTEGER", r"regexp_full_match(x, '-?\d+')"), ("DOUBLE", "try_cast(x AS DOUBLE) IS NOT NULL AND contains(x, '.')"), ("TIMESTAMP", _STAMP)], None),
)
def n2(spark, folder):
    return infer.infer_schema(load(spark, folder, _samples), INFER_COLUMNS, "ui")


# ---------------------------------------------------------------- mapping and predicates

MAPPINGS = [
    {"source_column": "name", "target_entity_type": "Person", "target_property": "full_name", "transformation": "UPPERCASE", "is_active": True},
    {"source_column": "email", "target_entity_type": "Person", "target_property": "mail", "transformation": "LOWERCASE", "is_active": True},
    {"source_column": "joined_at", "target_entity_type": "Person", "target_property": "since", "transformation": "DATE_PARSE", "is_active": True},
    {"source_column": "country", "target_entity_type": "Place", "target_property": "country", "transformation": "TRIM", "is_active": True},
    {"source_column": "age", "target_entity_type": "Person", "target_property": "age", "transformation": None, "is_active": True},
    {"source_column": "salary", "target_entity_type": "Person", "target_property": "pay", "transformation": None, "is_active": False},
]


@register("P1_apply_mappings_person", f"SELECT id, upper(name) AS full_name, lower(email) AS mail, {sql_date('joined_at')} AS since, age FROM ({PARTY})")
def p1(spark, folder):
    return mapping.apply_mappings(load(spark, folder, party), MAPPINGS, ["id"])["Person"]


@register("P1_apply_mappings_place", f"SELECT id, trim(country) AS country FROM ({PARTY})")
def p1b(spark, folder):
    return mapping.apply_mappings(load(spark, folder, party), MAPPINGS, ["id"])["Place"]


def _rules(d) -> str:
    return f"""SELECT 'c' || cast(l_partkey as string) AS source_column, 'p' || cast(l_suppkey as string) AS target_property,
    l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS created_at FROM {d.table('lineitem')}"""


@register(
    "P2_resolve_mapping_rules",
    f"""SELECT source_column, target_property, created_at FROM (SELECT *, max(created_at) OVER (PARTITION BY source_column) AS s,
    max(created_at) OVER (PARTITION BY target_property) AS t FROM (SELECT DISTINCT * FROM ({_rules(DUCK)}))) WHERE created_at = s AND created_at = t""",
)
def p2(spark, folder):
    return mapping.resolve_mapping_rules(load(spark, folder, _rules).distinct()).select("source_column", "target_property", "created_at")


@register("P2_mapper_rules", f"SELECT id, name AS direct, try_cast(salary AS DOUBLE) AS as_float, lower(trim(email)) AS normalized FROM ({PARTY})")
def p2b(spark, folder):
    return load(spark, folder, party).select(
        "id", mapping.mapper_rule("direct", F.col("name")).alias("direct"),
        mapping.mapper_rule("cast", F.col("salary"), "float").alias("as_float"), mapping.mapper_rule("normalize", F.col("email")).alias("normalized"),
    )


@register(
    "P3_mapping_coverage",
    """SELECT (SELECT count(DISTINCT p_partkey) FROM part) AS total_columns, (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN part ON p_partkey = l_partkey) AS mapped_columns,
    (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)) AS required_unfilled""",
)
def p3(spark, folder):
    columns = v.table(spark, folder, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("source_column"))
    properties = v.table(spark, folder, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("property"), (F.col("s_suppkey") % 2 == 0).alias("required"))
    return mapping.mapping_coverage(columns, properties, load(spark, folder, _rules))


@register("P4_include_columns", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def p4(spark, folder):
    off = {"o_custkey": False, "o_orderdate": False, "o_orderpriority": False, "o_totalprice": True}
    return mapping.include_columns(v.table(spark, folder, "orders"), off)


@register("P5_equality_filters", "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'error') AND user_id = 8")
def p5(spark, folder):
    return equality_filter(v.table(spark, folder, "events"), {"event_type": ["click", "error"], "user_id": 8}).select("event_id", "user_id", "event_type")


@register("P7_struct_fields", f"SELECT id, {sql_amount('salary')} AS amount, {sql_currency('salary')} AS currency FROM ({PARTY})")
def p7(spark, folder):
    parsed = load(spark, folder, party).select("id", parse_currency(F.col("salary")).alias("parsed"))
    return parsed.select("id", "parsed.amount", "parsed.currency")


@register("P8_tenant_scope", f"SELECT id, name FROM ({PARTY}) WHERE tenant_id = 'globex'")
def p8(spark, folder):
    return tenant_scope(load(spark, folder, party), "globex").select("id", "name")


@register("scalar_text", f"SELECT id, trim(name) AS stripped, lower(trim(name)) AS normalized, {sql_title('trim(name)')} AS titled FROM ({PARTY})")
def scalar_text(spark, folder):
    name = F.col("name")
    return load(spark, folder, party).select("id", strip(name).alias("stripped"), normalize(name).alias("normalized"), title_case(strip(name)).alias("titled"))


_NAMES = "SELECT DISTINCT p_name AS n FROM part"


@register(
    "D13_suggest_mappings",
    f"""SELECT source_column, property, score FROM (SELECT *, row_number() OVER (PARTITION BY source_column ORDER BY score DESC, property) AS r FROM (
    SELECT replace(array_to_string(list_transform(string_split(a.n, ' '), lambda w : upper(w[1]) || w[2:]), ' '), ' ', '') || '_Id' AS source_column, replace(b.n, ' ', '_') AS property,
    round(jaro_winkler_similarity(replace(a.n, ' ', '') || 'id', replace(b.n, ' ', '')), 4) AS score FROM ({_NAMES}) a, ({_NAMES}) b)) WHERE r = 1 AND score >= 0.7""",
)
def d13(spark, folder):
    columns = v.table(spark, folder, "part").select(F.concat(F.replace(F.initcap("p_name"), F.lit(" ")), F.lit("_Id")).alias("source_column")).distinct()
    properties = v.table(spark, folder, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("property")).distinct()
    return mapping.suggest_mappings(columns, properties)


@register(
    "D13_assign_mappings",
    f"""WITH RECURSIVE x AS (SELECT DISTINCT upper(replace(n, ' ', '')) AS source_column FROM ({_NAMES})), y AS (SELECT DISTINCT replace(n, ' ', '_') || '_' AS property FROM ({_NAMES}))
    SELECT source_column, property, 1.0::DOUBLE AS score FROM x JOIN y ON lower(source_column) = replace(property, '_', '')""",
)
def d13a(spark, folder):
    names = v.table(spark, folder, "part").select("p_name").distinct()
    columns = names.select(F.upper(F.replace("p_name", F.lit(" "))).alias("source_column")).distinct()
    properties = names.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_")).alias("property")).distinct()
    return mapping.assign_mappings(columns, properties, 0.9)
