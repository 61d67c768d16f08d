"""Entity graph on two tables: ``entities`` and ``relationships``."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .cluster import connected_components

MAX_DEPTH = 4
#: Folders an adjacency is written in, unless the caller asks for more.
PARTS = 64
#: Steps of a path put together before they are written: the plan of a long path stays short.
_STRETCH = 16
_PATH = "position int, id string, relationship_type string, source_entity_id string, target_entity_id string"


@dataclass(frozen=True)
class Adjacency:
    """Edges under each of their ends, as ``adjacency`` writes them: ``steps`` holds ``(tenant_id, relationship_type, at,
    to, forth, part)``, where ``forth`` says that ``at`` is the source of the edge."""

    steps: DataFrame
    parts: int

    def part(self, node: Column) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.parts)).cast("int")

    def around(self, level: DataFrame, parts: Iterable[int]) -> DataFrame:
        """The steps from the nodes of a level (a row per ``id``), read from the folders of ``parts`` alone."""
        return self.steps.filter(F.col("part").isin(list(parts))).join(level.select(F.col("id").alias("at")), "at")


def _of(relationships: DataFrame, tenant_id: str | None, relationship_type: str | None) -> DataFrame:
    if tenant_id is not None:
        relationships = relationships.filter(F.col("tenant_id") == tenant_id)
    if relationship_type is not None:
        relationships = relationships.filter(F.col("relationship_type") == relationship_type)
    return relationships


def _both_ways(relationships: DataFrame) -> DataFrame:
    held = relationships.filter("source_entity_id IS NOT NULL AND target_entity_id IS NOT NULL")
    forth = F.struct(F.col("source_entity_id").alias("at"), F.col("target_entity_id").alias("to"), F.lit(True).alias("forth"))
    back = F.struct(F.col("target_entity_id").alias("at"), F.col("source_entity_id").alias("to"), F.lit(False).alias("forth"))
    return held.select("tenant_id", "relationship_type", F.inline(F.array(forth, back)))


def adjacency(relationships: DataFrame, parts: int = PARTS, path: str | None = None) -> Adjacency:
    """``relationships`` written under each of their ends, in folders by the hash of that end and sorted by it.

    A step of a search then reads the folders of its frontier, and in them the row groups whose range of ids holds one.
    Written once, at ``path`` or in the shared folder, it serves any number of searches; to open one again, give its files
    and number of parts to ``Adjacency``. The folder of a node with many edges is split over tasks and files by adaptive
    execution. Edges with a null end lead nowhere and are left out; repeated edges stay.
    """
    spark = relationships.sparkSession
    steps = _both_ways(relationships).withColumn("part", F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int"))
    path = path or scratch_path(spark, "adjacency")
    steps.hint("rebalance", "part").sortWithinPartitions("part", "tenant_id", "at").write.partitionBy("part").parquet(path)
    return Adjacency(spark.read.schema(steps.schema).parquet(path), parts)


def _first(near: Adjacency, node: str) -> DataFrame:
    return near.steps.sparkSession.range(1).select(F.lit(node).alias("id"))


def _sizes(near: Adjacency, level: DataFrame, other: DataFrame | None = None) -> tuple[dict[int, int], bool]:
    """Nodes of a level per part (at most as many rows as parts), and whether it shares a node with another level."""
    met = F.lit(0)
    if other is not None:
        level = level.join(other.select("id", F.lit(1).alias("_met")), "id", "left")
        met = F.count("_met")
    rows = level.groupBy(near.part(F.col("id")).alias("part")).agg(F.count("*").alias("n"), met.alias("met")).collect()
    return {r["part"]: r["n"] for r in rows}, any(r["met"] for r in rows)


def _parts(near: Adjacency, level: DataFrame) -> set[int]:
    """The parts that hold the nodes of a level."""
    return {0} if near.parts == 1 else set(_sizes(near, level)[0])


def _beyond(reached: DataFrame, levels: Sequence[DataFrame]) -> DataFrame:
    """Nodes of ``reached`` that are new: edges lead both ways, so only the last two levels can hold one of them."""
    for level in levels[-2:]:
        reached = reached.join(level.select("id"), "id", "left_anti")
    return reached


def neighbourhood(relationships: DataFrame, entity_id: str, depth: int = 1, relationship_type: str | None = None, tenant_id: str | None = None,
                  near: Adjacency | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with their distance, edges between them) within ``depth`` (1 to 4) of an entity.

    ``near`` is an adjacency of ``relationships``; a step then joins the folders of its frontier alone. Without one a step
    reads the edges as they are: four steps do not repay a layout. Nodes seen are dropped by anti joins with the two
    levels before, and every level is written as a frame of its own. An entity without edges is its own neighbourhood.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    near = near or Adjacency(_both_ways(relationships).withColumn("part", F.lit(0)), 1)
    near = Adjacency(_of(near.steps, tenant_id, relationship_type), near.parts)
    levels, parts = [_first(near, entity_id)], set[int]()
    for _ in range(depth):
        here = _parts(near, levels[-1])
        parts |= here
        reached = near.around(levels[-1], here).select(F.col("to").alias("id")).distinct()
        levels.append(materialize(_beyond(reached, levels)))
    seen = levels[0].withColumn("distance", F.lit(0))
    for d, level in enumerate(levels[1:], 1):
        seen = seen.unionByName(level.withColumn("distance", F.lit(d)))
    parts |= _parts(near, levels[-1])
    ids = seen.select("id")
    inside = near.steps.filter(F.col("forth") & F.col("part").isin(list(parts)))
    inside = inside.join(ids, F.col("at") == ids["id"], "left_semi").join(ids, F.col("to") == ids["id"], "left_semi")
    return seen, inside.select("tenant_id", "relationship_type", F.col("at").alias("source_entity_id"), F.col("to").alias("target_entity_id"))


def shortest_path(relationships: DataFrame, source: str, target: str, tenant_id: str | None = None, relationship_type: str | None = None,
                  max_depth: int | None = None, near: Adjacency | None = None) -> DataFrame:
    """``(position, id, relationship_type, source_entity_id, target_entity_id)``: the nodes of a shortest path between two
    entities and the edge that led to each, the smallest ids among equals as seen from the target; empty when there is none.

    Breadth-first search from both ends, the side with the smaller frontier next, over ``near`` (an adjacency of
    ``relationships``, made here where none is given). Every level is a frame of its own. The search ends when the last
    levels of the sides share a node, when a side finds nothing new, or after ``max_depth`` steps in all where given.
    From the shared nodes the way goes on through the levels of the target, and the path is read backwards by a join with
    each level. An entity is its own path, also without edges.
    """
    near = near or adjacency(_of(relationships, tenant_id, relationship_type))
    near = Adjacency(_of(near.steps, tenant_id, relationship_type), near.parts)
    spark = near.steps.sparkSession
    columns = ("relationship_type", "source_entity_id", "target_entity_id")
    ends = F.when(F.col("forth"), F.col("at")).otherwise(F.col("to")), F.when(F.col("forth"), F.col("to")).otherwise(F.col("at"))
    edge = F.struct("relationship_type", ends[0].alias("source_entity_id"), ends[1].alias("target_entity_id"))
    via = F.min(F.struct("at", edge.alias("edge"))).alias("via")

    def onward(level: DataFrame, parts: Iterable[int]) -> DataFrame:
        """Nodes one step from a level, each with its smallest predecessor there and the edge between them."""
        return near.around(level, parts).groupBy(F.col("to").alias("id")).agg(via)

    forth, back = [_first(near, source)], [_first(near, target)]
    sizes = [[_sizes(near, forth[0])[0]], [_sizes(near, back[0])[0]]]
    met = source == target
    while not met:
        steps = len(forth) + len(back) - 2
        if max_depth is not None and steps >= max_depth:
            return spark.createDataFrame([], _PATH)
        ahead = sum(sizes[0][-1].values()) <= sum(sizes[1][-1].values())
        mine, other, size = (forth, back, sizes[0]) if ahead else (back, forth, sizes[1])
        reached = onward(mine[-1], size[-1])
        mine.append(materialize(_beyond(reached if ahead else reached.select("id"), mine)))
        found, met = _sizes(near, mine[-1], other[-1])
        size.append(found)
        if not found:
            return spark.createDataFrame([], _PATH)
    # the nodes of the shortest paths on the target's side, each with its way from the source
    tail = forth[-1].join(back[-1], "id", "left_semi") if len(forth) > 1 else forth[-1]
    for level, size in zip(back[-2::-1], sizes[1][:0:-1]):
        tail = materialize(onward(tail, size).join(level, "id", "left_semi"))
        forth.append(tail)
    kind = spark.createDataFrame([], _PATH).drop("position").schema.simpleString()
    step = lambda e: F.array(F.struct("id", *[F.col(f"{e}.{c}").alias(c) for c in columns]))
    row = None
    for k in range(len(forth) - 1, 0, -1):
        if row is None:
            here = forth[k].filter(F.col("id") == target)
            row = here.select(F.col("via.at").alias("at"), step("via.edge").alias("path"))
        else:
            # one row at every step
            here = forth[k].join(F.broadcast(row), F.col("id") == F.col("at"))
            row = here.select(F.col("via.at").alias("at"), F.concat(step("via.edge"), "path").alias("path"))
        if (len(forth) - k) % _STRETCH == 0:
            row = materialize(row)
    start = F.array(F.struct(F.lit(source).alias("id"), *[F.lit(None).cast("string").alias(c) for c in columns])).cast(f"array<{kind}>")
    row = spark.range(1).select(start.alias("path")) if row is None else row.select(F.concat(start, "path").alias("path"))
    return row.select(F.posexplode("path").alias("position", "n")).select("position", "n.*").coalesce(1)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Keyed merge in which the latest row by ``version`` wins; with the tenant among the keys tenants never mix."""
    latest = F.max_by(F.struct(*current.columns), F.struct(version)).alias("_row")
    both = current.unionByName(changes.select(*current.columns))
    return both.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(latest).select("_row.*")


def same_tenant_edges(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose ends both exist in the edge's tenant."""
    nodes = entities.select(F.col("tenant_id").alias("_t"), F.col("id").alias("_id"))
    for end in ("source_entity_id", "target_entity_id"):
        relationships = relationships.join(nodes, (F.col("tenant_id") == F.col("_t")) & (F.col(end) == F.col("_id")), "left_semi")
    return relationships


def degree_centrality(relationships: DataFrame, scope: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Edges per entity of a tenant, and their share of the tenant's other entities."""
    ends = relationships.select(*scope, F.col("source_entity_id").alias("id"), F.lit(0).alias("into")).unionByName(
        relationships.select(*scope, F.col("target_entity_id").alias("id"), F.lit(1).alias("into"))
    )
    degree = ends.groupBy(*scope, "id").agg(F.count("*").alias("degree"), F.sum("into").cast("bigint").alias("in_degree"))
    others = degree.groupBy(*[F.col(c).alias(f"_s_{c}") for c in scope]).agg((F.count("*") - 1).alias("_others"))
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in scope] or [F.lit(True)]
    share = F.when(F.col("_others") > 0, F.col("degree") / F.nullif(F.col("_others"), F.lit(0))).otherwise(F.lit(0.0))
    return degree.withColumn("out_degree", F.col("degree") - F.col("in_degree")).join(others, same).withColumn("centrality", share).drop("_others", *[f"_s_{c}" for c in scope])


def communities(relationships: DataFrame, scope: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """``(*scope, id, cluster_id)``: the connected groups of entities of each tenant."""
    return connected_components(relationships, "source_entity_id", "target_entity_id", scope)


def label_communities(relationships: DataFrame, scope: Sequence[str] = ("tenant_id",), weight: str | None = None, rounds: int = 20) -> DataFrame:
    """``(*scope, id, community)``: groups of entities more tightly bound to each other than to the rest.

    Weighted label propagation in synchronous rounds. Every entity begins with its own id as label; in a round it takes
    the label with the largest sum of edge weights around it, its own label counting as one edge of weight 1, and the
    smallest label among equals. It ends when no label changes, or after ``rounds``. Parallel edges add up, direction does
    not matter, an entity tied to itself alone stays alone; edges with a null end, or whose weight is null or not above
    0, are left out. A round is one join and two aggregates that combine on the map side, so a hub is no group of rows.
    """
    ends = relationships.select(*scope, F.col("source_entity_id").alias("id"), F.col("target_entity_id").alias("to"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    ends = ends.filter("id IS NOT NULL AND to IS NOT NULL AND w > 0")
    back = ends.select(*scope, F.col("to").alias("id"), F.col("id").alias("to"), "w")
    edges = materialize(ends.unionByName(back).filter("id <> to").groupBy(*scope, "id", "to").agg(F.sum("w").alias("w")), "id")
    labels = ends.select(*scope, "id").unionByName(back.select(*scope, "id")).distinct().withColumn("community", F.col("id"))
    labels = materialize(labels)
    best = F.min(F.struct((-F.col("w")).alias("less"), F.col("community").alias("label"))).alias("best")
    for _ in range(rounds):
        around = edges.join(labels.withColumnRenamed("id", "to"), [*scope, "to"]).select(*scope, "id", "community", "w")
        own = labels.select(*scope, "id", "community", F.lit(1.0).alias("w"))
        sums = around.unionByName(own).groupBy(*scope, "id", "community").agg(F.round(F.sum("w"), 9).alias("w"))
        taken = sums.groupBy(*scope, "id").agg(best).select(*scope, "id", F.col("best.label").alias("new"))
        step = materialize(labels.join(taken, [*scope, "id"]).select(*scope, "id", F.col("new").alias("community"), (F.col("new") != F.col("community")).alias("moved")))
        labels = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    return labels
