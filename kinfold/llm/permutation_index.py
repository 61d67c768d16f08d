"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its ``LISTED`` nearest of ``PIVOTS`` pivots and posted, with its place in that
order, in the inverted file of each of them. A query reads the files of its own nearest pivots only, which gives the
footrule distance of the two orders; the share of vectors with the least footrule is ranked by true distance.

Vectors are dealt to blocks of about ``BLOCK`` by a hash, and each block holds its own inverted files, so that no file
is longer than a block; the queries pass every block in turn and leave their best rows there. Equal vectors are one
entry with the few smallest ids any answer can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.session import materialize

PIVOTS = 512
LISTED = 128
BLOCK = 4096
#: Share of a block's vectors that are ranked by true distance, and the least number of them.
SHARE = 0.25
LEAST = 300


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite numbers, not all of them zero."""
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _orders(vectors: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first, ties to the earlier pivot."""
    far = (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :listed]


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` pivots from a sample, passing over those within half a typical distance of one already chosen.

    A group of nearly equal vectors would otherwise fill the orders with places that tell nothing.
    """
    if len(sample) <= count:
        return sample
    apart = lambda a, b: np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None, :], 0))
    few = sample[:256]
    least = 0.5 * float(np.median(apart(few, few)))
    gap = apart(sample, sample)
    chosen: list[int] = []
    free = np.ones(len(sample), bool)
    for i in range(len(sample)):
        if free[i] and len(chosen) < count:
            chosen.append(i)
            free &= gap[i] >= least
            free[i] = False
    rest = [i for i in range(len(sample)) if i not in set(chosen)]
    return sample[np.sort((chosen + rest)[:count])]


class _Block:
    """The inverted files of a block: for each pivot the entries that list it and at which place."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], pivots: np.ndarray, listed: int):
        self.vectors, self.ids, self.pivots, self.listed = vectors, ids, pivots, listed
        orders = _orders(vectors, pivots, listed)
        by_pivot = np.argsort(orders.ravel(), kind="stable")
        self.entry, self.place = by_pivot // listed, by_pivot % listed
        self.first = np.searchsorted(orders.ravel()[by_pivot], np.arange(len(pivots) + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of a query's order to every entry; a pivot not listed stands after the last place."""
        found = np.zeros(len(self.vectors), np.int32)
        for i, pivot in enumerate(order):
            a, b = self.first[pivot], self.first[pivot + 1]
            found[self.entry[a:b]] += np.abs(self.place[a:b] - i) - (self.listed - i)
        return found

    def search(self, queries: np.ndarray, want: int) -> Iterator[list[tuple[float, int]]]:
        """The ``want`` nearest ids of each query among the entries with the least footrule, with their distances."""
        n = len(self.vectors)
        ranked = min(n, max(LEAST, int(np.ceil(SHARE * n))))
        for query, order in zip(queries, _orders(queries, self.pivots, self.listed)):
            rule = self.footrule(order)
            near = np.flatnonzero(rule <= np.partition(rule, ranked - 1)[ranked - 1])
            gap = np.sqrt(((self.vectors[near] - query) ** 2).sum(axis=1))
            if len(near) > want:
                close = gap <= np.partition(gap, want - 1)[want - 1]
                near, gap = near[close], gap[close]
            yield sorted((float(g), i) for g, x in zip(gap, near) for i in self.ids[x])[:want]


def _searcher(shared, size: int, listed: int, want: int):
    schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, index = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            asks = batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            edge = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(blocks)]))):
                if a == b:
                    continue
                if blocks[a] != number:
                    number, held, index = blocks[a], [], None
                part = batch.slice(a, b - a)
                vectors = _rows(part.column("embedding"), size)
                if not asks[a]:
                    held.append((vectors, part.column("ids").to_pylist()))
                    continue
                if not held:
                    continue
                if index is None:
                    index = _Block(np.concatenate([v for v, _ in held]), [i for _, ids in held for i in ids], shared.value, listed)
                for cid, best in zip(part.column("cid").to_pylist(), index.search(vectors, want)):
                    if best:
                        yield pa.RecordBatch.from_arrays([pa.array([cid] * len(best), pa.int64()), pa.array([i for _, i in best], pa.int64()), pa.array([g for g, _ in best], pa.float64())], schema=schema)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest other vectors of every row for which ``is_query`` holds.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. Which vectors are ranked is
    approximate, the scores are exact. Null, empty and zero vectors and those with null or non-finite components take no
    part, nor do rows without an id, nor vectors with another number of components than most have. Of rows with equal
    ids the smallest vector counts. A query for which no other vector is left has no row; an empty table has none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("ask").alias("ask"))
    rows = materialize(rows.withColumn("cid", F.xxhash64("embedding")))
    size = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = size["size"]
    rows = rows.filter(F.size("embedding") == size)
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    entries = materialize(few.groupBy("cid").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("embedding").alias("embedding")))
    sample = entries.orderBy("cid").limit(4 * PIVOTS).select("embedding").collect()
    pivots = spread_pivots(np.array([r["embedding"] for r in sample], np.float64).reshape(-1, size), PIVOTS)
    shared = spark.sparkContext.broadcast(pivots)
    listed = min(LISTED, len(pivots))
    blocks = max(1, -(-entries.count() // BLOCK))
    asked = rows.filter("ask").select("cid", "vec_id")
    asking = entries.join(asked.select("cid").distinct(), "cid", "left_semi")
    index = entries.select(F.pmod(F.xxhash64("cid"), F.lit(blocks)).alias("block"), F.lit(False).alias("is_query"), "cid", "ids", "embedding")
    visits = asking.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("is_query"), "cid", "ids", "embedding")
    cells = index.unionByName(visits).repartition("block").sortWithinPartitions("block", "is_query")
    found = cells.mapInArrow(_searcher(shared, size, listed, k + 1), "query long, vec_id long, score double")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).filter(F.col("place") <= k + 1)
    answers = asked.select(F.col("vec_id").alias("query_id"), "cid").join(best.drop("place"), F.col("cid") == F.col("query")).filter("query_id <> vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
