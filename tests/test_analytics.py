import datetime

import pytest
from pyspark.sql import functions as F

from kinfold.operators import analytics, graph, monitoring, paging, quality, reconcile, search


def people(spark):
    rows = [("acme", "Person", "UK", 30, "2024-01-01 10:00:00"), ("acme", "Person", "UK", 40, "2024-01-01 23:59:59"), ("acme", "Person", "US", 50, "2024-01-02 00:00:00"), ("other", "Person", "UK", 99, "2024-01-08 00:00:00"), ("acme", "Firm", None, 1, "2024-01-03 12:00:00")]
    return spark.createDataFrame(rows, "tenant_id string, entity_type string, country string, age int, at string").withColumn("at", F.col("at").cast("timestamp"))


def test_query(spark):
    row = analytics.query(people(spark), ["count", "avg:age"], {"country": "UK"}, "acme", "Person").first()
    assert row.asDict() == {"count": 2, "avg_age": 35.0, "row_count": 2}
    assert analytics.query(people(spark), filters={"country": ["UK", "US"]}).first()["row_count"] == 4
    assert analytics.query(people(spark), filters={"country": None}).first()["row_count"] == 1
    for bad in ("nope:age", "avg"):
        with pytest.raises(ValueError):
            analytics.query(people(spark), [bad])


def test_timeseries(spark):
    days = [(r["timestamp"].day, r["value"]) for r in analytics.timeseries(people(spark), "at", "1d").collect()]
    assert days == [(1, 2), (2, 1), (3, 1), (8, 1)]
    weeks = [(r["timestamp"], r["value"]) for r in analytics.timeseries(people(spark), "at", "1w", "sum:age").collect()]
    assert weeks == [(datetime.datetime(2024, 1, 1), 121), (datetime.datetime(2024, 1, 8), 99)]
    with pytest.raises(ValueError):
        analytics.timeseries(people(spark), "at", "1 day")


def test_progress(spark):
    at = "timestamp '2026-01-01 00:00:00'"
    df = spark.sql(f"""SELECT * FROM VALUES ('a', 'RUNNING', {at}, NULL, 100, 50, 0), ('b', 'completed', {at}, {at}, 0, 0, 0), ('c', 'FAILED', {at}, timestamp '2025-12-31 00:00:00', 10, 50, 5),
        ('d', 'RUNNING', NULL, NULL, 0, 5, 0) AS t(id, status, started_at, completed_at, records_input, records_output, records_failed)""")
    got = {r["id"]: (r["duration_seconds"], r["progress"], r["throughput"]) for r in monitoring.with_progress(df, F.lit("2026-01-01 00:00:10").cast("timestamp")).collect()}
    assert got == {"a": (10, 50.0, 5.0), "b": (0, 100.0, 0.0), "c": (0, 100.0, 0.0), "d": (0, 0.0, 0.0)}
    totals = monitoring.monitor_totals(monitoring.with_progress(df, F.lit("2026-01-01 00:00:10").cast("timestamp"))).first()
    assert totals["count_all"] == 4 and totals["count_running"] == 2 and totals["total_throughput"] == 5.0
    assert monitoring.runs_with_status(df, " ").count() == 4 and monitoring.runs_with_status(df, "failed").count() == 1
    empty = monitoring.run_metrics(df.limit(0), spark.createDataFrame([], "status string")).first()
    assert empty["total_records_cleaned"] == 0 and empty["total_entities_resolved"] == 0


def test_pages(spark):
    df = spark.range(25)
    assert [r["id"] for r in paging.page(df, 2).collect()] == [20, 21, 22, 23, 24]
    assert paging.page_count(df).first()["pages"] == 3 and paging.page_count(df.limit(0)).first()["pages"] == 1
    texts = spark.createDataFrame([("Ann", None), ("Bo", "xANNx")], "a string, b string")
    assert paging.preview_search(texts, "ann").count() == 2 and paging.preview_search(texts, " ").count() == 2


def edges(spark, *pairs):
    return spark.createDataFrame([("t", "KNOWS", a, b) for a, b in pairs], "tenant_id string, relationship_type string, source_entity_id string, target_entity_id string")


def test_graph(spark):
    rel = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "x"), ("x", "d"))
    nodes, inside = graph.neighbourhood(rel, "a", 2)
    assert {r["id"]: r["distance"] for r in nodes.collect()} == {"a": 0, "b": 1, "x": 1, "c": 2, "d": 2} and inside.count() == 5
    assert [r["id"] for r in graph.shortest_path(rel, "a", "e").collect()] == ["a", "x", "d", "e"]
    assert graph.shortest_path(rel, "a", "nobody").count() == 0 and [r["id"] for r in graph.shortest_path(rel, "a", "a").collect()] == ["a"]
    assert graph.neighbourhood(rel, "a", 2, tenant_id="other")[0].count() == 1
    with pytest.raises(ValueError):
        graph.neighbourhood(rel, "a", 5)


def test_search_marks_the_term(spark):
    df = spark.createDataFrame([("1", "Alice Smith", "Person", "s"), ("2", "Bob", "Firm", "alice")], "id string, name string, entity_type string, city string")
    assert search.search(df, "alice", ["name", "city"], "Person").first()["highlights"] == {"name": "<em>Alice</em> Smith"}


def test_reconciliation(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert reconcile.reconciliation_report({"pg": a, "graph": a}, ["v"], scope=[]).first()["status"] == "HEALTHY"
    b = spark.createDataFrame([(1, "x"), (2, "z")], "id int, v string")
    row = reconcile.reconciliation_report({"pg": a, "graph": a.filter("id = 1"), "search": b}, ["v"], scope=[]).first()
    assert (row["status"], row["missing_ids"], row["different_ids"], row["graph_count"]) == ("DRIFT_DETECTED", 1, 1, 1)


def test_outliers_without_groups(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 2, 1, 2, 3, 100]], "v double")
    assert [r["v"] for r in quality.flag_outliers(df, "v", method="iqr").filter("is_outlier").collect()] == [100.0]


def test_exact_percentiles_need_no_group_in_one_task(spark):
    import random

    import numpy as np

    random.seed(8)
    groups = {"hot": [float(random.choice(range(40))) for _ in range(3000)], "wide": [random.gauss(0, 1) for _ in range(2000)], "one": [7.0], "two": [1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in [*values, None]], "g string, v double")
    asked = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = {(r["g"], r["percentile"]): r["value"] for r in analytics.exact_percentiles(df, "v", asked, ["g"]).collect()}
    assert got == pytest.approx({(g, q): float(np.percentile(values, q * 100)) for g, values in groups.items() for q in asked})
    whole = analytics.statistics(df, "v").first()
    everything = [v for values in groups.values() for v in values]
    assert whole["n"] == len(everything) and whole["median"] == pytest.approx(float(np.median(everything)))


def test_reconciliation_keeps_tenants_apart(spark):
    a = spark.createDataFrame([("t1", 1, "x"), ("t2", 1, "y")], "tenant_id string, id int, v string")
    b = spark.createDataFrame([("t2", 1, "y"), ("t1", 1, "z")], "tenant_id string, id int, v string")
    assert [tuple(r) for r in reconcile.compare_stores({"pg": a, "graph": b}, ["v"]).collect()] == [("t1", "1", [], True)]


def test_graph_keeps_tenants_apart(spark):
    edges = spark.createDataFrame([("t1", "R", "a", "b"), ("t2", "R", "b", "c")], "tenant_id string, relationship_type string, source_entity_id string, target_entity_id string")
    assert {(r["tenant_id"], r["id"]): r["cluster_id"] for r in graph.communities(edges).collect()} == {("t1", "a"): "a", ("t1", "b"): "a", ("t2", "b"): "b", ("t2", "c"): "b"}
    assert {(r["tenant_id"], r["id"]): (r["degree"], r["centrality"]) for r in graph.degree_centrality(edges).collect()}[("t1", "b")] == (1, 1.0)


def test_long_paths_are_found_with_their_edges(spark):
    edges = spark.createDataFrame([("t", "R", f"n{i}", f"n{i + 1}") for i in range(9)], "tenant_id string, relationship_type string, source_entity_id string, target_entity_id string")
    path = graph.shortest_path(edges, "n9", "n0").collect()
    assert [r["id"] for r in path] == [f"n{i}" for i in range(9, -1, -1)]
    assert [(r["source_entity_id"], r["target_entity_id"]) for r in path[1:]] == [(f"n{i}", f"n{i + 1}") for i in range(8, -1, -1)]
    assert graph.shortest_path(edges, "n0", "n9", max_depth=3).count() == 0


def test_page_after_walks_the_whole_table(spark):
    rows = [(i, [None, 1, 2, 3][i % 4]) for i in range(23)]
    df = spark.createDataFrame(rows, "id int, v int")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got, last = [], None
    while True:
        some = (paging.page(df, 0, 5, [F.col("v").desc_nulls_last(), "id"]) if last is None else paging.page_after(df, last, [("v", False), ("id", True)], 5)).collect()
        if not some:
            break
        got += [(r["id"], r["v"]) for r in some]
        last = {"id": some[-1]["id"], "v": some[-1]["v"]}
    assert got == want


def test_numbers_do_not_depend_on_the_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("id"), F.when(F.col("id") % 3 == 0, "a").alias("g"))
    got = {(r["g"], r["id"]): r["_number"] for r in paging.numbered(df, ["g"], ["id"]).collect()}
    want = {}
    for g in ("a", None):
        ids = sorted(r["id"] for r in df.filter(F.col("g").eqNullSafe(g)).collect())
        want |= {(g, i): n + 1 for n, i in enumerate(ids)}
    assert got == want


def test_likely_duplicate_parts_may_differ_in_the_first_word(spark, tmp_path):
    from workload.analytics import flagship

    rows = [(1, "almond blue ivory peru snow", "B1", "T1"), (2, "allmond blue ivory peru snow", "B1", "T1"), (3, "Almond blue ivory peru snow", "B1", "T1"),
            (4, "azure blue ivory peru snow", "B1", "T1"), (5, "almond blue ivory peru snow", "B1", "T2"), (6, "tan lime red", "B1", "T1")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    # 1 and 3 are equal, 2 is one edit of 28 from both, 4 is five edits of 27 from 1 and 3 and six of 28 from 2
    near, far = round(1 - 1 / 28, 4), [round(1 - 5 / 27, 4)] * 2 + [round(1 - 6 / 28, 4)]
    got = {r["decision"]: (r["pairs"], r["avg_score"]) for r in flagship(spark, str(tmp_path)).collect()}
    assert got == {"match": (3, pytest.approx((1 + 2 * near) / 3, abs=1e-8)), "review": (3, pytest.approx(sum(far) / 3, abs=1e-8))}


def test_stores_are_compared_by_buckets(spark):
    """The rows are those of a full comparison, whatever the buckets; repeats, moved nulls and null ids are told apart."""
    import random

    rng = random.Random(3)
    base = [(rng.choice(["t", "u"]), i, rng.choice([None, "a", "b"]), rng.choice([None, "a", "b"])) for i in range(300)]
    other = [r for r in base if r[1] % 41] + [("t", 900, "a", "a")]
    other = [(t, i, b, a) if i % 37 == 0 else (t, i, a, b) for t, i, a, b in other]
    schema = "tenant_id string, id int, v string, w string"
    one, two = spark.createDataFrame(base, schema).withColumn("_bucket", F.lit("clash")), spark.createDataFrame(other, schema).withColumn("_bucket", F.lit(0))
    left, right = {r[:2]: r[2:] for r in base}, {r[:2]: r[2:] for r in other}
    wanted = {(*k, ("two",) if k not in right else ("one",) if k not in left else (), k in left and k in right) for k in left.keys() | right.keys() if left.get(k) != right.get(k)}
    for buckets in (1, 16, 1 << 16):
        found = reconcile.compare_stores({"one": one, "two": two}, ["v", "w"], buckets=buckets).collect()
        assert {(r.tenant_id, int(r.id), tuple(r.missing_in), bool(r.differs)) for r in found} == wanted
    assert reconcile.compare_stores({"one": one, "two": one, "three": one}, ["v", "w"]).count() == 0
    twice = one.unionByName(one.limit(1)).unionByName(one.limit(1))
    checksums = reconcile.reconciliation_report({"one": one, "two": twice}, ["v", "w"]).first()
    assert checksums["one_checksum"] != checksums["two_checksum"]
    nobody = spark.createDataFrame([("t", None, "a", "a")], schema)
    assert reconcile.compare_stores({"one": nobody, "two": nobody.limit(0)}, ["v", "w"]).count() == 1
    assert reconcile.compare_stores({"one": nobody.limit(0), "two": nobody.limit(0)}, ["v", "w"]).count() == 0


def plain_communities(edges, rounds):
    from collections import defaultdict

    weight = defaultdict(float)
    for a, b, w in edges:
        if a is not None and b is not None and w and w > 0 and a != b:
            weight[a, b] += w
            weight[b, a] += w
    label = {x: x for a, b, w in edges if a is not None and b is not None and w and w > 0 for x in (a, b)}
    for _ in range(rounds):
        new = {}
        for x in label:
            sums = defaultdict(float)
            sums[label[x]] += 1
            for (a, b), w in weight.items():
                if a == x:
                    sums[label[b]] += w
            new[x] = min(sums, key=lambda c: (-round(sums[c], 9), c))
        if new == label:
            break
        label = new
    return label


def test_label_communities(spark):
    import itertools
    import random

    cliques = [(a, b, 1.0) for group in ("abcd", "wxyz") for a, b in itertools.combinations(group, 2)]
    schema = "source_entity_id string, target_entity_id string, w double"
    df = spark.createDataFrame([*cliques, ("d", "w", 1.0)], schema)
    assert {r.id: r.community for r in graph.label_communities(df, scope=[]).collect()} == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("wxyz", "w")}
    rng = random.Random(4)
    edges = [(f"{rng.randrange(40):02d}", f"{rng.randrange(40):02d}", rng.choice([1.0, 2.0, 0.5, None, 0.0])) for _ in range(90)]
    edges += [("hub", f"{i:02d}", 0.25) for i in range(40)] + [("self", "self", 1.0), (None, "01", 1.0), ("01", None, 1.0), edges[0], edges[0]]
    df = spark.createDataFrame(edges, schema)
    for rounds in (1, 3, 20):
        assert {r.id: r.community for r in graph.label_communities(df, scope=[], weight="w", rounds=rounds).collect()} == plain_communities(edges, rounds)
    two = df.withColumn("tenant_id", F.lit("t")).unionByName(df.withColumn("tenant_id", F.lit("u")))
    assert graph.label_communities(two, weight="w", rounds=2).count() == 2 * len(plain_communities(edges, 2))
    assert graph.label_communities(df.limit(0), scope=[]).count() == 0


def plain_levels(pairs, start):
    """Distance of every node reached from ``start``."""
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    far, level = {start: 0}, [start]
    while level:
        level = sorted({y for x in level for y in around.get(x, ())} - set(far))
        far.update({y: max(far.values()) + 1 for y in level})
    return far, around


def plain_path(pairs, source, target):
    """A shortest path, the smallest predecessor taken at every step back from the target."""
    far, around = plain_levels(pairs, source)
    if target not in far:
        return []
    path = [target]
    while path[-1] != source:
        path.append(min(x for x in around[path[-1]] if far.get(x) == far[path[-1]] - 1))
    return path[::-1]


def test_searches_over_an_adjacency_agree_with_a_plain_search(spark):
    import random

    random.seed(31)
    pairs = [(f"n{random.randrange(60)}", f"n{random.randrange(60)}") for _ in range(75)]
    pairs += [("hub", f"n{i}") for i in range(0, 60, 9)] + [("far1", "far2"), ("n3", "n3")] + pairs[:6]
    rel = edges(spark, *pairs, ("n1", None), (None, "n2"))
    near = graph.adjacency(rel, parts=8)
    for source, target in [("n1", "n40"), ("n59", "n2"), ("n7", "far1"), ("far1", "far2"), ("n5", "n33")]:
        wanted = plain_path(pairs, source, target)
        got = graph.shortest_path(rel, source, target, near=near).collect()
        assert [r.id for r in got] == wanted and [r.position for r in got] == list(range(len(wanted)))
        assert all({a.id, b.id} == {b.source_entity_id, b.target_entity_id} for a, b in zip(got, got[1:]))
    far, _ = plain_levels(pairs, "n1")
    within = {k: d for k, d in far.items() if d <= 3}
    for given in (near, None):
        nodes, inside = graph.neighbourhood(rel, "n1", 3, near=given)
        assert {r.id: r.distance for r in nodes.collect()} == within
        assert sorted((r.source_entity_id, r.target_entity_id) for r in inside.collect()) == sorted(p for p in pairs if set(p) <= set(within))
    assert graph.neighbourhood(rel.limit(0), "n1", 2)[0].count() == 1 and graph.shortest_path(rel.limit(0), "n1", "n2").count() == 0


def test_a_step_reads_the_folders_of_its_frontier(spark, tmp_path):
    rel = edges(spark, *[(f"n{i}", f"n{i + 1}") for i in range(400)])
    made = graph.adjacency(rel, parts=16, path=str(tmp_path / "near"))
    near = graph.Adjacency(spark.read.parquet(str(tmp_path / "near")), made.parts)
    level = spark.createDataFrame([("n7",)], "id string")
    sizes, _ = graph._sizes(near, level)
    step = near.around(level, sizes)
    assert sorted(r.to for r in step.collect()) == ["n6", "n8"] and len(sizes) == 1
    plan = step._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan
    assert len({f.split("part=")[1].split("/")[0] for f in near.steps.inputFiles()}) == 16


def test_edges_are_made_distinct_once_few_are_left(spark, tmp_path):
    """Rows that repeat, or have null keys, give the edges they gave when all rows were made distinct first."""
    from workload import views
    from workload.analytics import d3e

    folder = str(tmp_path)
    spark.createDataFrame([(1,), (1,), (2,), (None,)], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(10, 1), (10, 1), (11, 2), (12, 1), (13, 9), (14, None), (None, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(10, 5), (10, 5), (None, 5), (10, None)], "l_orderkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    found = d3e(spark, folder)
    nodes = spark.createDataFrame([("acme", f"c{k}") for k in (1, 2)] + [("acme", "o10"), ("acme", "o11"), ("acme", "o13"), ("acme", "o14"), ("globex", "o12")], "tenant_id string, id string")
    before = graph.same_tenant_edges(views.load(spark, folder, views.relationships), nodes).select("source_entity_id", "target_entity_id")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(found) == key(before) == [("c1", "o10"), ("c2", "o11")]
    plan = d3e(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")
