"""Connected components over matched pairs and the attachment of records to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparison_value
from ..session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Edges point from the larger to the smaller."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes with several parents, or with a parent and children: none are left when every component is one star."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)")


def connected_components(edges: DataFrame, id_a: str = "id_a", id_b: str = "id_b", scope: Sequence[str] = (), max_rounds: int = 64,
                         as_text: bool = True) -> DataFrame:
    """``(*scope, id, cluster_id)`` for every node of the edge list; ``cluster_id`` is the smallest id of the component.

    ``scope`` names columns both ends of an edge share (the tenant): equal ids of different scopes are different nodes.
    Ids are compared and returned as text. With ``as_text`` false numbers stay numbers, which aggregate without sorting if
    there is no scope; an edge with a null end links nothing then.

    Alternating large-star / small-star (Kiveris et al., 2014): a logarithmic number of rounds, each an aggregate
    combined on the map side and a join that adaptive execution splits when a hub is hot. No neighbour list is ever
    collected. Each round is written to the shared folder, which keeps the lineage short and survives lost executors;
    the driver only asks whether any node is not yet linked straight to its root.
    """
    shown = lambda c: F.col(c).cast("string") if as_text else F.col(c)
    bare = not (as_text or scope)
    node = lambda c: shown(c) if bare else F.struct(*scope, shown(c).alias("id"))
    current = materialize(
        edges.select(F.greatest(node(id_a), node(id_b)).alias("u"), F.least(node(id_a), node(id_b)).alias("v"))
        .filter("u <> v").distinct()
    )
    for _ in range(max_rounds):
        if _unsettled(current).isEmpty():
            break
        current = materialize(_small_star(_large_star(current)))
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    if bare:
        return current.select(F.col("u").alias("id"), F.col("v").alias("cluster_id")).unionByName(
            current.select(F.col("v").alias("id"), F.col("v").alias("cluster_id")).distinct())
    named = lambda n, root: [F.col(f"{n}.{c}").alias(c) for c in (*scope, "id")] + [F.col(f"{root}.id").alias("cluster_id")]
    return current.select(*named("u", "v")).unionByName(current.select(*named("v", "v")).distinct())


def attach_clusters(records: DataFrame, components: DataFrame, id_col: str = "id", scope: Sequence[str] = ()) -> DataFrame:
    """Add ``cluster_id``; a record no match touches is its own cluster, an id without a record is dropped."""
    lookup = components.select(*scope, F.col("id").alias("_node"), "cluster_id")
    same = [records[c] == lookup[c] for c in scope] + [records[id_col].cast("string") == lookup["_node"]]
    joined = records.join(lookup, same, "left").select(*[records[c] for c in records.columns], lookup["cluster_id"])
    return joined.withColumn("cluster_id", F.coalesce("cluster_id", F.col(id_col).cast("string")))


def attach_profile_clusters(records: DataFrame, profs: DataFrame, components: DataFrame, attributes: Sequence[str],
                            group: Sequence[str] = ("tenant_id", "block_key"), id_col: str = "id", blank_as_null: bool = True) -> DataFrame:
    """Add ``cluster_id`` to records through their profile.

    ``group`` starts with the scope the components were computed in. Copies follow their profile. Records with none of the compared values have a score of 0 among themselves and stay
    single.
    """
    present = [c for c in attributes if c in profs.columns]
    assigned = attach_clusters(profs.withColumnRenamed("profile_id", "id"), components, "id", group[:1]).select(
        *[F.col(c).alias(f"_p_{c}") for c in (*group, *present)], F.col("cluster_id").alias("_p_cluster")
    )
    same = [F.col(c) == F.col(f"_p_{c}") for c in group]
    same += [comparison_value(F.col(c), blank_as_null).eqNullSafe(F.col(f"_p_{c}")) for c in present]
    joined = records.join(assigned, same, "left")
    nothing = F.coalesce(*[F.col(f"_p_{c}") for c in present]).isNull()
    own = F.col(id_col).cast("string")
    cluster = F.when(nothing, own).otherwise(F.coalesce("_p_cluster", own))
    return joined.withColumn("cluster_id", cluster).drop(*[c for c in joined.columns if c.startswith("_p_")])
