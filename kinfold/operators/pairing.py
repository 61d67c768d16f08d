"""Candidate pairs by declared passes: rows meet where they share the key of a pass, spread over a grid of tiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JARO_WINKLER, LEVENSHTEIN = "jaro_winkler", "levenshtein"
ROWS_PER_TILE = 2048


def tiled_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: Column, left_id: str, right_id: str, rows_per_tile: int = ROWS_PER_TILE) -> DataFrame:
    """Equi-join on ``keys`` in which a key with very many rows is spread over a grid of tiles, one task unit each.

    ``left`` and ``right`` have the key columns under the same names and no other column in common. The rows of a key on
    each side (counted on the map side) say over how many tiles that side is dealt; a row goes to as many tiles as the
    other side has. Every pair meets in exactly one tile: the size of the tiles never changes the rows. The tiles are
    dealt by number: a tile is few bytes and much work, and adaptive execution would pack them by their bytes.
    """
    sized = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    large = lambda name: F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(name), F.lit(0)) / F.lit(rows_per_tile)).cast("int"))
    counts = sized(left, "_cl").join(sized(right, "_cr"), list(keys)).filter((F.col("_cl") > rows_per_tile) | (F.col("_cr") > rows_per_tile))
    tiles = counts.select(*keys, large("_cl").alias("_kl"), large("_cr").alias("_kr"))
    k_left, k_right = (F.coalesce(F.col(c), F.lit(1)) for c in ("_kl", "_kr"))
    own = lambda c, k: F.pmod(F.xxhash64(c), k).cast("int")
    grid = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    spark, cell = left.sparkSession, [*keys, "_i", "_j"]
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(32, 4 * spark.sparkContext.defaultParallelism))
    lt = left.join(tiles, list(keys), "left").withColumns({"_i": own(left_id, k_left), "_j": grid(k_right)}).drop("_kl", "_kr")
    rt = right.join(tiles, list(keys), "left").withColumns({"_j": own(right_id, k_right), "_i": grid(k_left)}).drop("_kl", "_kr")
    return lt.repartition(n, *cell).join(rt.repartition(n, *cell), cell, "inner").filter(on).drop("_i", "_j")


def pass_pairs(df: DataFrame, group: Sequence[str], id_col: str, passes: Sequence[Column], carry: Sequence[str] = (),
               rows_per_tile: int = ROWS_PER_TILE, where: Column | None = None) -> DataFrame:
    """Pairs of rows of a group that share the key of at least one pass, smaller id first, each once.

    A null or empty key meets no other. A pair that shares several keys is kept in the first of these passes, which both
    rows can tell by themselves. Columns of ``carry`` come as ``_a`` and ``_b``; ``where`` is a condition on them, checked
    inside the join. The same passes hold for groups of any size, so the pairs follow from the values alone.
    """
    keys = F.array(*[F.nullif(p, F.lit("")) for p in passes])
    rows = df.select(*group, id_col, *carry, keys.alias("_keys")).select("*", F.posexplode("_keys").alias("_pass", "_key")).filter("_key IS NOT NULL")
    side = lambda s: rows.select(*group, "_pass", "_key", *[F.col(c).alias(f"{c}{s}") for c in (id_col, *carry, "_keys")])
    earlier = [(F.col("_pass") > i) & (F.col("_keys_a")[i] == F.col("_keys_b")[i]) for i in range(len(passes) - 1)]
    met = reduce(lambda a, b: a | b, [F.coalesce(e, F.lit(False)) for e in earlier], F.lit(False))
    on = (F.col(f"{id_col}_a") < F.col(f"{id_col}_b")) & ~met
    if where is not None:
        on = on & where
    pairs = tiled_join(side("_a"), side("_b"), [*group, "_pass", "_key"], on, f"{id_col}_a", f"{id_col}_b", rows_per_tile)
    return pairs.drop("_pass", "_key", "_keys_a", "_keys_b")
