"""Derived inputs, written once as SQL that Spark and DuckDB both read.

The driver's tables hold no people, so a party table is derived from the customers: three copies per person with
different spelling, dirty text, planned gaps, eight date layouts and four currencies. Names are spelled from the digits
of the key, so their number grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.operators.cleaning import clean


class Spark:
    """How Spark names a table of a folder and writes a back reference."""

    def __init__(self, folder: str):
        self.folder = folder

    def table(self, name: str) -> str:
        return f"parquet.`{self.folder}/{name}.parquet`"

    def spell(self, number: str) -> str:
        return f"translate(regexp_replace(cast({number} as string), '([0-9])', '$1a'), '0123456789', 'bdfklmnprs')"


class Duck:
    def table(self, name: str) -> str:
        return name

    def spell(self, number: str) -> str:
        return f"translate(regexp_replace(cast({number} as string), '([0-9])', '\\1a', 'g'), '0123456789', 'bdfklmnprs')"


def party(d) -> str:
    return f"""
SELECT 'c' || lpad(cast(c_custkey as string), 12, '0') AS id,
  CASE WHEN b % 5 = 0 THEN 'globex' ELSE 'acme' END AS tenant_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'crm' ELSE 'feed-' || cast(c_custkey % 7 as string) END AS source_id,
  CASE WHEN c_custkey % 37 = 5 THEN NULL WHEN c_custkey % 41 = 7 THEN '   '
       WHEN k = 0 THEN first_name || sep || last_name
       WHEN k = 1 THEN '  ' || upper(first_name || sep || last_name) || ' '
       ELSE first_name || sep || substr(last_name, 1, 1) || 'e' || substr(last_name, 3) END AS name,
  CASE WHEN c_custkey % 53 = 0 THEN NULL WHEN c_custkey % 59 = 1 THEN 'unknown'
       WHEN k = 0 THEN first_name || '.' || last_name || '@example.com'
       WHEN k = 1 THEN ' ' || upper(first_name || '.' || last_name) || '@Example.COM'
       ELSE first_name || '.' || last_name || '.x@example.com' END AS email,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 20 + c_custkey % 50 END AS age,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN k = 1 THEN '  ' || lower(n_name) ELSE n_name END AS country,
  CASE WHEN b % 7 = 0 THEN 'organization' WHEN k = 1 THEN ' PERSON ' ELSE 'person' END AS entity_type,
  CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN k = 2 AND b % 2 = 0 THEN substr(born, 1, 9) || '9' ELSE born END AS dob,
  CASE WHEN c_custkey % 23 = 0 THEN NULL
       WHEN c_custkey % 9 = 0 THEN joined || ' 08:30:00'
       WHEN c_custkey % 9 = 1 THEN joined || 'T08:30:00'
       WHEN c_custkey % 9 = 2 THEN joined || 'T08:30:00Z'
       WHEN c_custkey % 9 = 3 THEN joined || 'T08:30:00+0200'
       WHEN c_custkey % 9 = 4 THEN substr(joined, 9, 2) || '/' || substr(joined, 6, 2) || '/' || substr(joined, 1, 4)
       WHEN c_custkey % 9 = 5 THEN substr(joined, 6, 2) || '/' || substr(joined, 9, 2) || '/' || substr(joined, 1, 4)
       WHEN c_custkey % 9 = 6 THEN ' ' || joined || ' '
       WHEN c_custkey % 9 = 7 THEN substr(joined, 9, 2) || '-' || substr(joined, 6, 2) || '-' || substr(joined, 1, 4)
       ELSE 'not a date' END AS joined_at,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal END AS score,
  CASE WHEN c_custkey % 29 = 0 THEN NULL
       WHEN c_custkey % 6 = 0 THEN '$1,' || lpad(cast(c_custkey % 1000 as string), 3, '0') || '.50'
       WHEN c_custkey % 6 = 1 THEN cast(cast(c_acctbal as decimal(12, 2)) as string) || ' €'
       WHEN c_custkey % 6 = 2 THEN '£' || cast(c_custkey as string)
       WHEN c_custkey % 6 = 3 THEN ' ¥ ' || cast(c_custkey % 900 as string)
       WHEN c_custkey % 6 = 4 THEN cast(cast(c_acctbal as decimal(12, 2)) as string)
       ELSE 'by agreement' END AS salary
FROM (
  SELECT c_custkey, c_acctbal, b, k, n_name, {d.spell('b + 1000')} AS last_name, {d.spell('b % 97 + 10')} AS first_name,
    CASE WHEN b % 10 = 3 THEN '-' ELSE ' ' END AS sep,
    cast(date '1950-01-01' + cast(b % 20000 as int) as string) AS born,
    cast(date '2020-01-01' + cast(c_custkey % 1500 as int) as string) AS joined
  FROM (SELECT c_custkey, c_acctbal, cast(floor(c_custkey / 3) as bigint) AS b, c_custkey % 3 AS k FROM {d.table('customer')}) c
  JOIN {d.table('nation')} n ON n.n_nationkey = c.b % 25
) v"""


def runs(d) -> str:
    return f"""
SELECT 'run-' || cast(o_orderkey as string) AS id, 'conn-' || cast(o_custkey % 150 as string) AS connection_id,
  'acme' AS tenant_id, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS status,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderdate END AS started_at,
  CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 90 MINUTE
       WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 45 SECOND ELSE o_orderdate - INTERVAL 5 SECOND END AS completed_at,
  CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE cast(floor(o_totalprice) as bigint) END AS records_input,
  cast(floor(o_totalprice * (o_orderkey % 5) / 4) as bigint) AS records_output, o_orderkey % 11 AS records_failed
FROM {d.table('orders')}"""


def connectors(d) -> str:
    return f"""
SELECT 'conn-' || cast(s_suppkey as string) AS id, s_name AS name,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'POSTGRESQL' ELSE 'FILE' END AS type
FROM {d.table('supplier')}"""


def entities(d) -> str:
    return f"""
SELECT cast(event_id as string) AS id, 'tenant-' || cast(user_id % 3 as string) AS tenant_id, event_type AS entity_type,
  'user ' || {d.spell('user_id')} AS name, 'src-' || cast(user_id % 5 as string) AS source_id, ts AS created_at, value,
  CASE WHEN event_id % 4 = 0 THEN 'pending' ELSE 'completed' END AS status
FROM {d.table('events')}"""


def relationships(d, union: str = "UNION") -> str:
    """``UNION ALL`` leaves rows that repeat to the caller."""
    return f"""
SELECT 'acme' AS tenant_id, 'PLACED' AS relationship_type, 'c' || cast(o_custkey as string) AS source_entity_id,
  'o' || cast(o_orderkey as string) AS target_entity_id FROM {d.table('orders')}
{union}
SELECT 'acme', 'CONTAINS', 'o' || cast(l_orderkey as string), 'p' || cast(l_partkey as string) FROM {d.table('lineitem')}"""


def candidates(d) -> str:
    """Review candidates; the snapshot of record B is spread over three columns here."""
    return f"""
SELECT 'cand-' || cast(o_orderkey as string) AS id, 'acme' AS tenant_id, 'gr-' || cast(o_custkey as string) AS golden_record_id,
  'a' || cast(o_custkey as string) AS record_a_id, 'b' || cast(o_orderkey as string) AS record_b_id,
  round(0.7 + (o_orderkey % 20) / 100.0, 4) AS similarity_score,
  CASE WHEN o_orderkey % 10 = 0 THEN 'ACCEPTED' WHEN o_orderkey % 10 = 1 THEN 'REJECTED' ELSE 'PENDING' END AS status,
  'score of name and mail' AS comparison_details, o_orderpriority AS b_priority,
  CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'phone-' || cast(o_orderkey % 3 as string) END AS b_phone,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'city-' || cast(o_orderkey % 5 as string) END AS b_city
FROM {d.table('orders')}"""


def golden_state(d) -> str:
    return f"""
SELECT 'gr-' || cast(c_custkey as string) AS golden_id, 'acme' AS tenant_id, cast(1 as bigint) AS version,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE '1-URGENT' END AS g_priority,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'phone-' || cast(c_custkey % 3 as string) END AS g_phone, c_mktsegment AS g_segment
FROM {d.table('customer')}"""


def decisions(d) -> str:
    return f"""
SELECT 'cand-' || cast(CASE WHEN o_orderkey % 50 = 3 THEN -o_orderkey ELSE o_orderkey END as string) AS candidate_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'REJECT' ELSE 'ACCEPT' END AS decision, o_orderdate AS decided_at,
  'analyst-' || cast(o_orderkey % 4 as string) AS decided_by
FROM {d.table('orders')} WHERE o_orderstatus <> 'F'
UNION ALL
SELECT 'cand-' || cast(o_orderkey as string), 'REJECT', o_orderdate + INTERVAL 1 DAY, 'analyst-9'
FROM {d.table('orders')} WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW'"""


def load(spark: SparkSession, folder: str, view) -> DataFrame:
    return spark.sql(view(Spark(folder)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return clean(load(spark, folder, party))


# ---------------------------------------------------------------- SQL twins of shared steps (DuckDB)

DUCK = Duck()
PARTY = party(DUCK)


def sql_title(x: str) -> str:
    piece = "list_transform(string_split(w, '-'), lambda p : upper(p[1]) || p[2:])"
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w : array_to_string({piece}, '-')), ' ')"


def sql_date(x: str) -> str:
    t = f"trim({x})"
    formats = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%SZ', '%d/%m/%Y', '%m/%d/%Y', '%Y-%m-%d', '%d-%m-%Y']"
    return (
        f"CASE WHEN {x} IS NULL OR {t} = '' THEN '' "
        f"WHEN regexp_full_match({t}, '.*T.*[+-][0-9]{{4}}') THEN substr({t}, 1, 19) || substr({t}, 20, 3) || ':' || substr({t}, 23, 2) "
        f"ELSE coalesce(strftime(try_strptime({t}, {formats}), '%Y-%m-%dT%H:%M:%S+00:00'), {t}) END"
    )


def sql_amount(x: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract(replace({x}, ',', ''), '[-+]?\\d*\\.\\d+|[-+]?\\d+'), '') AS DOUBLE), 0.0)"


def sql_currency(x: str) -> str:
    t = f"trim({x})"
    cases = " ".join(
        f"WHEN starts_with({t}, '{s}') OR ends_with({t}, '{s}') THEN '{c}'" for s, c in (("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"))
    )
    return f"CASE {cases} ELSE 'USD' END"


CLEANED = f"""
SELECT id, tenant_id, source_id, coalesce({sql_title('trim(name)')}, '') AS name, coalesce(lower(trim(email)), '') AS email,
  coalesce(age, 0) AS age, coalesce(upper(trim(country)), '') AS country, coalesce(trim(entity_type), '') AS entity_type,
  coalesce(trim(dob), '') AS dob, {sql_date('joined_at')} AS joined_at, coalesce(score, 0.0) AS score,
  {sql_amount('salary')} AS salary_amount, {sql_currency('salary')} AS salary_currency
FROM ({PARTY})"""

# phonetic key of the spelled names: consonant-vowel syllables, so only the consonants remain and d sounds like t
SQL_CODE = "upper(translate(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z ]', '', 'g'), '[aeiou]', '', 'g'), 'd', 't'))"
KEYED = f"""
SELECT *, coalesce(nullif({SQL_CODE}, ''), 'EMPTY') || '_' || coalesce(nullif(country, ''), 'GLOBAL') || '_' ||
  coalesce(nullif({sql_title('entity_type')}, ''), 'DEFAULT') AS block_key FROM ({CLEANED})"""
