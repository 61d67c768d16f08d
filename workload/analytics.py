"""Aggregation, rollups, monitoring, paging, graph, search and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import analytics, graph, monitoring, paging, reconcile, rollups, search
from kinfold.sources.jdbc import discover_columns, discover_tables, search_tables

from . import views as v
from .registry import register
from .views import DUCK, PARTY, load, party, table

ENT, RUNS, CONN, REL = (f(DUCK) for f in (v.entities, v.runs, v.connectors, v.relationships))
NOW = "2030-01-01 00:00:00"


def entities(spark, folder):
    return load(spark, folder, v.entities)


def rounded(df, *columns, places=4):
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


# ---------------------------------------------------------------- aggregation


@register(
    "A1_query",
    f"""SELECT count(*) AS count, round(avg(value), 4) AS avg_value, round(sum(value), 2) AS sum_value, min(value) AS min_value, max(value) AS max_value, count(*) AS row_count
    FROM ({ENT}) WHERE tenant_id = 'tenant-1' AND entity_type = 'click' AND status = 'completed'""",
)
def a1(spark, folder):
    asked = ["count", "avg:value", "sum:value", "min:value", "max:value"]
    found = analytics.query(entities(spark, folder), asked, {"status": "completed"}, "tenant-1", "click")
    return rounded(rounded(found, "avg_value"), "sum_value", places=2)


@register(
    "A1_query_grouped",
    f"SELECT entity_type, source_id, count(*) AS count, round(avg(value), 4) AS avg_value, count(DISTINCT name) AS count_distinct_name, count(*) AS row_count FROM ({ENT}) GROUP BY 1, 2",
)
def a1g(spark, folder):
    found = analytics.query(entities(spark, folder), ["count", "avg:value", "count_distinct:name"], group_by=["entity_type", "source_id"])
    return rounded(found, "avg_value")


@register("A1_query_no_aggregates", f"SELECT count(*) AS row_count FROM ({ENT}) WHERE tenant_id = 'tenant-0'")
def a1n(spark, folder):
    return analytics.query(entities(spark, folder), tenant_id="tenant-0")


@register("A2_stddev", f"SELECT entity_type, round(stddev_samp(value), 4) AS stddev_value, count(*) AS row_count FROM ({ENT}) GROUP BY 1")
def a2(spark, folder):
    return rounded(analytics.query(entities(spark, folder), ["stddev:value"], group_by=["entity_type"]), "stddev_value")


@register(
    "A3_statistics",
    """SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 2) AS mean, round(median(l_extendedprice), 4) AS median,
    round(stddev_samp(l_extendedprice), 2) AS stddev, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
    round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1""",
)
def a3(spark, folder):
    found = analytics.statistics(table(spark, folder, "lineitem"), "l_extendedprice", group_by=["l_returnflag"])
    return rounded(rounded(found, "median", "p25", "p50", "p75", "p95"), "mean", "stddev", places=2)


@register(
    "A3_distribution",
    "SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21 ELSE cast(floor(value / 5) AS BIGINT) + 1 END AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
)
def a3d(spark, folder):
    return analytics.distribution(table(spark, folder, "events"), "value", 0.0, 100.0, 20)


@register("A4_timeseries_day", f"SELECT date_trunc('day', created_at)::TIMESTAMP AS timestamp, count(*) AS value FROM ({ENT}) WHERE status = 'completed' GROUP BY 1 ORDER BY 1")
def a4(spark, folder):
    return analytics.timeseries(entities(spark, folder), "created_at", "1d", "count", {"status": "completed"})


@register(
    "A4_timeseries_hour",
    f"SELECT date_trunc('hour', created_at)::TIMESTAMP AS timestamp, round(sum(value), 2) AS value FROM ({ENT}) WHERE tenant_id = 'tenant-2' AND entity_type = 'purchase' GROUP BY 1 ORDER BY 1",
)
def a4h(spark, folder):
    return rounded(analytics.timeseries(entities(spark, folder), "created_at", "1h", "sum:value", None, "tenant-2", "purchase"), "value", places=2)


@register("A4_timeseries_week", f"SELECT date_trunc('week', created_at)::TIMESTAMP AS timestamp, round(avg(value), 4) AS value FROM ({ENT}) GROUP BY 1 ORDER BY 1")
def a4w(spark, folder):
    return rounded(analytics.timeseries(entities(spark, folder), "created_at", "1w", "avg:value"), "value")


@register(
    "A4_stored_rollup_day",
    f"""SELECT entity_type, date_trunc('day', created_at)::TIMESTAMP AS timestamp, count(value) AS n, round(sum(value), 2) / count(value) AS mean, round(stddev_samp(value), 4) AS stddev,
    min(value) AS least, max(value) AS most FROM ({ENT}) WHERE value IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2""",
)
def a4r(spark, folder):
    hours = rollups.rollup(entities(spark, folder), "created_at", "1h", "value", ["entity_type"])
    days = rollups.summary(rollups.merged(hours, "1d", ["entity_type"]), (), ["entity_type"])
    # values have two decimals: so has their sum, and a mean of it is no matter of the order of addition
    return rounded(days, "stddev").withColumn("mean", F.round(F.col("mean") * F.col("n"), 2) / F.col("n"))


# ---------------------------------------------------------------- monitoring


def runs(spark, folder):
    return load(spark, folder, v.runs)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


_PROGRESS = f"""SELECT *, CASE WHEN duration_seconds > 0 AND records_output > 0 AND status = 'RUNNING' THEN records_output / duration_seconds ELSE 0.0 END AS throughput FROM (
  SELECT *, CASE WHEN started_at IS NULL THEN 0 ELSE greatest(0, cast(floor(epoch(coalesce(completed_at, TIMESTAMP '{NOW}') - started_at)) AS BIGINT)) END AS duration_seconds,
  CASE WHEN records_input > 0 THEN least(100.0, records_output / records_input * 100.0) WHEN status = 'COMPLETED' THEN 100.0 ELSE 0.0 END AS progress FROM ({RUNS}))"""


@register(
    "A5_run_metrics",
    f"""SELECT coalesce(sum(records_output), 0)::BIGINT AS total_records_cleaned, count(*) FILTER (WHERE status = 'RUNNING') AS active_jobs, coalesce(sum(records_failed), 0)::BIGINT AS total_records_failed,
    count(*) AS total_runs, (SELECT count(*) FROM ({v.candidates(DUCK)}) WHERE status = 'ACCEPTED') AS total_entities_resolved FROM ({RUNS})""",
)
def a5(spark, folder):
    return monitoring.run_metrics(runs(spark, folder), load(spark, folder, v.candidates))


@register("A6_run_progress", f"SELECT id, duration_seconds, round(progress, 6) AS progress, round(throughput, 6) AS throughput FROM ({_PROGRESS})")
def a6(spark, folder):
    return rounded(monitoring.with_progress(runs(spark, folder), now()).select("id", "duration_seconds", "progress", "throughput"), "progress", "throughput", places=6)


@register(
    "A7_monitor_totals",
    f"""SELECT round(sum(throughput) FILTER (WHERE status = 'RUNNING'), 4) AS total_throughput, sum(records_input)::BIGINT AS total_input, sum(records_failed)::BIGINT AS total_failed, count(*) AS count_all,
    count(*) FILTER (WHERE status = 'RUNNING') AS count_running, count(*) FILTER (WHERE status = 'CLEANED') AS count_cleaned, count(*) FILTER (WHERE status = 'COMPLETED') AS count_completed,
    count(*) FILTER (WHERE status = 'FAILED') AS count_failed FROM ({_PROGRESS})""",
)
def a7(spark, folder):
    return rounded(monitoring.monitor_totals(monitoring.with_progress(runs(spark, folder), now())), "total_throughput")


@register(
    "A8_sync_totals",
    f"""SELECT sum(records_input)::BIGINT AS total_records, sum(records_output)::BIGINT AS total_synced, sum(records_failed)::BIGINT AS total_failed,
    round(sum(records_output) / sum(records_input) * 100.0, 6) AS overall_percent FROM ({RUNS})""",
)
def a8(spark, folder):
    named = runs(spark, folder).selectExpr("records_input AS total_records", "records_output AS synced_records", "records_failed AS failed_records")
    return rounded(monitoring.sync_totals(named), "overall_percent", places=6)


@register(
    "J1_runs_with_connector",
    f"""SELECT r.id, r.connection_id, coalesce(c.name, 'Pipeline') AS connector_name, coalesce(c.type, 'Database') AS connector_type FROM ({RUNS}) r LEFT JOIN ({CONN}) c ON c.id = r.connection_id""",
)
def j1(spark, folder):
    return monitoring.with_connector(runs(spark, folder), load(spark, folder, v.connectors)).select("id", "connection_id", "connector_name", "connector_type")


@register("P9_runs_with_status", f"SELECT id, status FROM ({RUNS}) WHERE status = 'FAILED'")
def p9(spark, folder):
    return monitoring.runs_with_status(runs(spark, folder), "failed").select("id", "status")


@register("M2_runs_newest_first", f"SELECT id, started_at FROM ({RUNS}) ORDER BY started_at DESC NULLS LAST, id")
def m2(spark, folder):
    return monitoring.newest_first(runs(spark, folder)).select("id", "started_at")


@register("M4_page", f"SELECT id, status FROM (SELECT * FROM ({RUNS}) ORDER BY started_at DESC NULLS LAST, id LIMIT 10 OFFSET 30)")
def m4(spark, folder):
    return paging.page(runs(spark, folder), 3, 10, [F.col("started_at").desc_nulls_last(), "id"]).select("id", "status")


@register("M4_page_after", f"SELECT id, status FROM (SELECT * FROM ({RUNS}) ORDER BY started_at DESC NULLS LAST, id LIMIT 10 OFFSET 40)")
def m4a(spark, folder):
    """The page after the one that ends with the fortieth row."""
    order = [("started_at", False), ("id", True)]
    rows = runs(spark, folder)
    last = paging.page(rows, 39, 1, [F.col("started_at").desc_nulls_last(), "id"]).select("started_at", "id").first()
    return paging.page_after(rows, last.asDict(), order, 10).select("id", "status")


@register("M4_page_count", f"SELECT greatest(1, ceil(count(*) / 10.0))::BIGINT AS pages FROM ({RUNS})")
def m4c(spark, folder):
    return paging.page_count(runs(spark, folder), 10)


@register("S9_preview", f"SELECT id, name, email FROM ({PARTY}) ORDER BY id LIMIT 100")
def s9(spark, folder):
    return paging.preview(load(spark, folder, party).select("id", "name", "email"), ["id"])


_SEARCHED = ["id", "name", "email", "country", "salary"]


@register(
    "S10_preview_search",
    f"SELECT {', '.join(_SEARCHED)} FROM ({PARTY}) WHERE " + " OR ".join(f"contains(lower(coalesce({c}, '')), 'kaba')" for c in _SEARCHED),
)
def s10(spark, folder):
    return paging.preview_search(load(spark, folder, party).select(*_SEARCHED), "KABA")


def _catalog(d) -> str:
    return f"""SELECT CASE WHEN doc_id % 17 = 0 THEN 'pg_catalog' WHEN doc_id % 19 = 0 THEN 'information_schema' ELSE 'crawl_' || source END AS table_schema,
    'Doc_' || lang || '_' || cast(doc_id as string) AS table_name, CASE WHEN doc_id % 5 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type, doc_id FROM {d.table('documents')}"""


_USER = f"SELECT table_schema, table_name FROM ({_catalog(DUCK)}) WHERE table_type = 'BASE TABLE' AND table_schema NOT IN ('pg_catalog', 'information_schema')"


@register("S5_discover_tables", f"{_USER} ORDER BY 1, 2")
def s5(spark, folder):
    return discover_tables(load(spark, folder, _catalog))


@register(
    "S6_discover_columns",
    "SELECT 'col_' || cast(l_linenumber AS string) AS column_name FROM lineitem WHERE l_orderkey % 50 = 7 AND l_returnflag = 'A' ORDER BY l_linenumber",
)
def s6(spark, folder):
    columns = table(spark, folder, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_orderkey") % 50).cast("string")).alias("table_schema"), F.col("l_returnflag").alias("table_name"),
        F.concat(F.lit("col_"), F.col("l_linenumber").cast("string")).alias("column_name"), F.col("l_linenumber").alias("ordinal_position"),
    )
    return discover_columns(columns, "s7", "A")


@register("S11_search_tables", f"SELECT * FROM ({_USER}) WHERE contains(lower(table_name), 'doc_fr') OR contains(lower(table_schema), 'doc_fr') ORDER BY 1, 2")
def s11(spark, folder):
    return discover_tables(search_tables(load(spark, folder, _catalog), "DOC_fr"))


# ---------------------------------------------------------------- graph


def relationships(spark, folder):
    return load(spark, folder, v.relationships)


_BOTH = f"both_ways AS (SELECT source_entity_id AS x, target_entity_id AS y FROM ({REL}) UNION SELECT target_entity_id, source_entity_id FROM ({REL}))"
_NEAR = f"""{_BOTH}, walk(id, d) AS (SELECT 'c7', 0 UNION SELECT y, d + 1 FROM walk JOIN both_ways ON x = id WHERE d < 3), near AS (SELECT id, min(d) AS distance FROM walk GROUP BY 1)"""


@register("D1_neighbourhood_nodes", f"WITH RECURSIVE {_NEAR} SELECT * FROM near")
def d1(spark, folder):
    edges = relationships(spark, folder)
    return graph.neighbourhood(edges, "c7", 3, tenant_id="acme", near=graph.adjacency(edges))[0]


@register(
    "D1_neighbourhood_edges",
    f"WITH RECURSIVE {_NEAR} SELECT source_entity_id, target_entity_id, relationship_type FROM ({REL}) WHERE source_entity_id IN (SELECT id FROM near) AND target_entity_id IN (SELECT id FROM near)",
)
def d1e(spark, folder):
    return graph.neighbourhood(relationships(spark, folder), "c7", 3, tenant_id="acme")[1].select("source_entity_id", "target_entity_id", "relationship_type")


@register(
    "D2_shortest_path",
    f"""WITH RECURSIVE {_BOTH}, walk(id, d) AS (SELECT 'c7', 0 UNION SELECT y, d + 1 FROM walk JOIN both_ways ON x = id WHERE d < 8),
    dist AS (SELECT id, min(d) AS d FROM walk GROUP BY 1),
    back(id, d) AS (SELECT id, d FROM dist WHERE id = 'c19' UNION
      SELECT * FROM (SELECT min(p.id) AS id, b.d - 1 AS d FROM back b JOIN both_ways e ON e.y = b.id JOIN dist p ON p.id = e.x AND p.d = b.d - 1 GROUP BY b.d)),
    path AS (SELECT d AS position, id, lag(id) OVER (ORDER BY d) AS before FROM back)
    SELECT position, id, CASE WHEN before IS NOT NULL THEN (SELECT min(relationship_type) FROM ({REL}) r
      WHERE (r.source_entity_id = path.id AND r.target_entity_id = path.before) OR (r.target_entity_id = path.id AND r.source_entity_id = path.before)) END AS relationship_type
    FROM path""",
)
def d2(spark, folder):
    return graph.shortest_path(relationships(spark, folder), "c7", "c19", "acme").select("position", "id", "relationship_type")


@register(
    "D3_upsert",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM (
    SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 2 = 1)) WHERE r = 1""",
)
def d3(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value")
    return graph.upsert(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@register(
    "D3_same_tenant_edges",
    f"""WITH n AS (SELECT 'acme' AS t, 'c' || c_custkey AS id FROM customer UNION ALL SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'globex' ELSE 'acme' END, 'o' || o_orderkey FROM orders)
    SELECT source_entity_id, target_entity_id FROM ({REL}) r WHERE EXISTS (SELECT 1 FROM n WHERE t = r.tenant_id AND id = source_entity_id) AND EXISTS (SELECT 1 FROM n WHERE t = r.tenant_id AND id = target_entity_id)""",
)
def d3e(spark, folder):
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("id")
    people = table(spark, folder, "customer").select(F.lit("acme").alias("tenant_id"), text("c", "c_custkey"))
    orders = table(spark, folder, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "globex").otherwise("acme").alias("tenant_id"), text("o", "o_orderkey"))
    rows = load(spark, folder, lambda d: v.relationships(d, "UNION ALL"))  # made distinct once few are left
    return graph.same_tenant_edges(rows, people.unionByName(orders)).distinct().select("source_entity_id", "target_entity_id")


@register(
    "D12_degree_centrality",
    f"""WITH two AS (SELECT tenant_id, source_entity_id AS s, target_entity_id AS t FROM ({REL}) UNION ALL SELECT 'globex', source_entity_id, target_entity_id FROM ({REL}) WHERE relationship_type = 'PLACED'),
    e AS (SELECT tenant_id, s AS id, 0 AS i FROM two UNION ALL SELECT tenant_id, t, 1 FROM two), g AS (SELECT tenant_id, id, count(*) AS degree, sum(i)::BIGINT AS in_degree FROM e GROUP BY 1, 2)
    SELECT tenant_id, id, degree, in_degree, degree - in_degree AS out_degree, degree / (count(*) OVER (PARTITION BY tenant_id) - 1) AS centrality FROM g""",
)
def d12(spark, folder):
    rows = relationships(spark, folder)
    return graph.degree_centrality(rows.unionByName(rows.filter("relationship_type = 'PLACED'").withColumn("tenant_id", F.lit("globex"))))


def _pairs(d) -> str:
    return f"SELECT CASE WHEN c_custkey % 2 = 0 THEN 'acme' ELSE 'globex' END AS tenant_id, 'a' || cast(c_custkey as string) AS source_entity_id, 'a' || cast(c_custkey + 1 + c_custkey % 4 as string) AS target_entity_id FROM {d.table('customer')} WHERE c_custkey % 5 <> 0"


@register(
    "D12_communities",
    f"""WITH RECURSIVE e AS (SELECT tenant_id AS t, source_entity_id AS x, target_entity_id AS y FROM ({_pairs(DUCK)}) UNION SELECT tenant_id, target_entity_id, source_entity_id FROM ({_pairs(DUCK)})),
    reach(t, x, y) AS (SELECT t, x, x FROM e UNION SELECT r.t, r.x, e.y FROM reach r JOIN e ON e.t = r.t AND e.x = r.y) SELECT t AS tenant_id, x AS id, min(y) AS cluster_id FROM reach GROUP BY 1, 2""",
)
def d12c(spark, folder):
    return graph.communities(load(spark, folder, _pairs))


def _propagated(rounds: int) -> str:
    """Rounds of label propagation written out one by one."""
    steps = [f"e AS (SELECT t, x, y, sum(w) AS w FROM (SELECT tenant_id AS t, source_entity_id AS x, target_entity_id AS y, 1 AS w FROM ({_pairs(DUCK)}) UNION ALL SELECT tenant_id, target_entity_id, source_entity_id, 1 FROM ({_pairs(DUCK)})) WHERE x <> y GROUP BY 1, 2, 3)",
             "l0 AS (SELECT DISTINCT t, x, x AS c FROM e)"]
    for k in range(rounds):
        steps.append(f"""l{k + 1} AS (SELECT t, x, first(c ORDER BY w DESC, c) AS c FROM (SELECT t, x, c, sum(w) AS w FROM (
            SELECT e.t, e.x, l.c, e.w FROM e JOIN l{k} l ON l.t = e.t AND l.x = e.y UNION ALL SELECT t, x, c, 1 FROM l{k}) GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
    return f"WITH {', '.join(steps)} SELECT t AS tenant_id, x AS id, c AS community FROM l{rounds}"


@register("D12_label_communities", _propagated(4))
def d12l(spark, folder):
    return graph.label_communities(load(spark, folder, _pairs), rounds=4)


# ---------------------------------------------------------------- search and reconciliation


@register(
    "D4_search",
    f"""SELECT id, name, regexp_replace(name, '(dafa)', '<em>\\1</em>', 'gi') AS marked FROM ({ENT}) WHERE contains(lower(name), 'dafa') AND entity_type = 'view'
    ORDER BY id LIMIT 20 OFFSET 0""",
)
def d4(spark, folder):
    found = search.search(entities(spark, folder), "DaFa", ["name", "source_id"], "view")
    return paging.page(found.select("id", "name", F.col("highlights")["name"].alias("marked")), 0, 20)


@register("D5_facets", f"SELECT entity_type, count(*) AS n FROM ({ENT}) WHERE contains(lower(name), 'da') GROUP BY 1")
def d5(spark, folder):
    return analytics.facet_counts(search.search(entities(spark, folder), "da", ["name"]))


@register(
    "D14_filter_results",
    f"SELECT id FROM ({ENT}) WHERE entity_type = 'click' AND source_id = 'src-3' AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-12'",
)
def d14(spark, folder):
    return search.filter_results(entities(spark, folder), "click", "src-3", "2024-01-05 00:00:00", "2024-01-12 00:00:00").select("id")


def _stores(spark, folder):
    rows = table(spark, folder, "customer").select(F.lit("acme").alias("tenant_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal")
    drifted = F.when(F.col("id") % 31 == 0, F.lit("stale")).otherwise(F.col("name"))
    # the ids of the second tenant are those of the first; nothing of it has drifted
    other = rows.withColumns({"tenant_id": F.lit("globex"), "name": F.lit("other")})
    sides = {"relational": rows, "graph": rows.filter("id % 13 <> 0"), "search": rows.filter("id % 17 <> 0").withColumn("name", drifted)}
    return {name: df.unionByName(other) for name, df in sides.items()}


_STORES = """WITH s AS (SELECT c_custkey AS id, c_custkey % 13 = 0 AS no_graph, c_custkey % 17 = 0 AS no_search, c_custkey % 17 <> 0 AND c_custkey % 31 = 0 AS stale FROM customer)"""


@register(
    "D6_compare_stores",
    f"""{_STORES} SELECT 'acme' AS tenant_id, cast(id AS string) AS id, concat_ws(',', CASE WHEN no_graph THEN 'graph' END, CASE WHEN no_search THEN 'search' END) AS missing_in, stale AS differs
    FROM s WHERE no_graph OR no_search OR stale""",
)
def d6(spark, folder):
    drift = reconcile.compare_stores(_stores(spark, folder), ["name", "c_acctbal"])
    return drift.withColumn("missing_in", F.array_join("missing_in", ","))


@register(
    "D6_reconciliation_report",
    f"""{_STORES} SELECT 2 * count(*) AS relational_count, count(*) + count(*) FILTER (WHERE NOT no_graph) AS graph_count, count(*) + count(*) FILTER (WHERE NOT no_search) AS search_count,
    count(*) FILTER (WHERE no_graph OR no_search) AS missing_ids, count(*) FILTER (WHERE stale) AS different_ids, 'DRIFT_DETECTED' AS status FROM s""",
)
def d6r(spark, folder):
    report = reconcile.reconciliation_report(_stores(spark, folder), ["name", "c_acctbal"])
    return report.select("relational_count", "graph_count", "search_count", "missing_ids", "different_ids", "status")


def _types(spark, folder):
    rows = table(spark, folder, "part").select(F.concat(F.lit("type-"), F.col("p_partkey").cast("string")).alias("type_name"), F.col("p_type").alias("definition"), "p_partkey")
    changed = F.when(F.col("p_partkey") % 7 == 0, F.lit("changed")).otherwise(F.col("definition"))
    return rows.filter("p_partkey % 5 <> 0"), rows.filter("p_partkey % 3 <> 0").withColumn("definition", changed)


@register(
    "D7_ontology_diff",
    """SELECT 'type-' || p_partkey AS type_name, CASE WHEN p_partkey % 5 = 0 THEN 'ADDED' WHEN p_partkey % 3 = 0 THEN 'REMOVED' ELSE 'MODIFIED' END AS change FROM part
    WHERE (p_partkey % 5 = 0) <> (p_partkey % 3 = 0) OR (p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 7 = 0)""",
)
def d7(spark, folder):
    return reconcile.ontology_diff(*_types(spark, folder))


# ---------------------------------------------------------------- likely duplicates among parts


def _part_names(spark, folder):
    from kinfold.functions.text import normalize
    from kinfold.operators.blocking import stored_profiles

    parts = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("id"), normalize(F.col("p_name")).alias("code"), F.col("p_brand").alias("brand"), F.col("p_type").alias("block_key")
    )
    return stored_profiles(parts, ["code"], ["brand", "block_key"])


@register(
    "flagship_likely_duplicate_parts",
    """SELECT brand, decision, sum(n)::BIGINT AS pairs, round(sum(score * n) / sum(n), 8) AS avg_score FROM (
    SELECT brand, score, n, CASE WHEN score >= 0.9 THEN 'match' WHEN score >= 0.7 THEN 'review' ELSE 'non_match' END AS decision FROM (
    SELECT a.p_brand AS brand, round(1.0 - levenshtein(lower(a.p_name), lower(b.p_name))::DOUBLE / greatest(length(a.p_name), length(b.p_name)), 4) AS score, count(*) AS n
    FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey GROUP BY 1, 2)) WHERE decision <> 'non_match' GROUP BY 1, 2""",
)
def flagship(spark, folder):
    """Per brand: how many likely duplicates among the parts of a type, and how sure are we."""
    from kinfold.plans.resolution import MatchSpec, copies, linked_pairs

    spec = MatchSpec(weights={"code": 1.0}, tenant="brand")
    profs = _part_names(spark, folder)
    head = ["brand", "decision", "confidence_score", "record_pairs"]
    both = linked_pairs(profs, spec).select(*head).unionByName(copies(profs, spec).select(*head))
    weight = F.col("record_pairs")
    return both.groupBy("brand", "decision").agg(
        F.sum(weight).cast("bigint").alias("pairs"), F.round(F.sum(F.col("confidence_score") * weight) / F.sum(weight), 8).alias("avg_score")
    )
