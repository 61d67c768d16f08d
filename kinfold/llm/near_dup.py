"""Near duplicates by an inverted join over MinHash coordinates, confirmed on whole shingle sets.

Every document has ``COORDINATES`` MinHash coordinates. A pair of documents with similarity at or above the bound
agrees in at least ``need`` of the first ``POSTED`` coordinates but for a chance of ``MISS`` (binomial tail), so it is
enough to find the pairs with that many collisions. Documents are posted under coordinate-value pairs, frequent lists
last: two documents with ``need`` common values out of ``m`` shared ones must meet in one of each document's
``m - need + 1`` rarest lists (prefix), and the remaining long lists are skipped by the merge and only probed, by
counting the collisions of the packed signatures.

No list or group is paired in full into rows. Lists are cut into tiles, so the largest list is spread over many tasks,
and a tile returns its colliding documents as stars: clusters, at most a row per document and tile. The documents of a
cluster then meet with their whole sets, again tile by tile, and a tile returns what its true links connect as stars
around the smallest id, which are components already where no two tiles meet. The first tile of a cluster meets all others first; where that already joins the cluster, it is done.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.cluster import connected_components
from kinfold.session import materialize, release, scratch_path

from . import tokens as T
from .sides import narrow

COORDINATES = 160
POSTED = 64
MISS = 1e-7
TILE = 1024
SET_TILE = 512


def collisions_needed(coordinates: int, percent: int, miss: float = MISS) -> int:
    """The largest count that a pair of ``percent`` similarity reaches with a chance of at least ``1 - miss``."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return t
    return coordinates


def _shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes by document, their starts, and a hash of each whole set."""
    data, offsets = T.buffers(texts)
    values, first = T.distinct(*T.shingles(T.words(T.lower(data), offsets), size))
    with np.errstate(over="ignore"):
        whole = T.mix(T.fold(np.add, T.mix(values ^ np.uint64(0x5851F42D4C957F2D)), first, np.uint64(0)) + np.diff(first).astype(np.uint64))
    return values, first, whole


def _signer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in T.slices(whole_batch):
                values, first, whole = _shingle_sets(batch.column("text"), size)
                short = (values >> np.uint64(32)).astype(np.uint32)
                n = np.diff(first)
                posted = np.zeros((len(n), POSTED), np.uint32)
                packed = np.zeros((len(n), COORDINATES), np.uint8)
                for c in range(COORDINATES):
                    least = T.fold(np.minimum, T.mix32(short, 0x9E3779B1 * (c + 1)), first, np.uint32(0))
                    packed[:, c] = (T.mix32(least, 77) >> np.uint32(24)).astype(np.uint8)
                    if c < POSTED:
                        posted[:, c] = least
                empty = n == 0
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(n.astype(np.int64)),
                    pa.array(whole.view(np.int64), mask=empty),
                    T.ragged(posted.view(np.int32).ravel(), np.arange(len(n) + 1) * POSTED, pa.int32()),
                    pa.array([row.tobytes() for row in packed], pa.binary()),
                ], ["doc_id", "text_hash", "n_shingles", "cid", "sig", "packed"])

    return run


def _set_reader(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in T.slices(whole_batch):
                values, first, whole = _shingle_sets(batch.column("text"), size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("want"), pa.array(whole.view(np.int64)), T.ragged(values.view(np.int64), first, pa.int64())],
                    ["want", "cid", "shingles"],
                )

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each group of equal ``names`` in turn, if more than one; a partition arrives sorted by them."""
    held: list[pa.Table] = []

    def cut(table: pa.Table, last: bool):
        marks = np.column_stack([table.column(c).to_numpy() for c in names])
        edge = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        bounds = np.concatenate(([0], edge, [len(marks)]))
        stop = len(bounds) - 1 if last else len(bounds) - 2
        for a, b in zip(bounds[:stop], bounds[1: stop + 1]):
            if b - a > 1:
                yield table.slice(a, b - a)
        return table.slice(int(bounds[stop]))

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= 4 * TILE or sum(t.nbytes for t in held) >= 64 << 20:
                held = [(yield from cut(pa.concat_tables(held).combine_chunks(), False))]
    if held:
        yield from cut(pa.concat_tables(held).combine_chunks(), True)


def _stars(near: np.ndarray, inner: bool, node: np.ndarray) -> Iterator[tuple[int, int]]:
    """The components of a graph as stars: the smallest ``node`` of each with every other. The graph is a square matrix
    (``inner``), or a matrix between two sides, whose columns are numbered after its rows."""
    if inner:
        links = near | near.T
    else:
        a, b = near.shape
        links = np.zeros((a + b, a + b), bool)
        links[:a, a:], links[a:, :a] = near, near.T
    open_ = links.any(axis=1)
    while open_.any():
        front = [int(np.argmax(open_))]
        open_[front[0]] = False
        held = list(front)
        while front:
            new = np.flatnonzero(links[front.pop()] & open_)
            open_[new] = False
            front.extend(new.tolist())
            held.extend(new.tolist())
        ids = node[held]
        least = ids.min()
        yield from ((least, x) for x in ids if x != least)


def _fits_size(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])


def _collide(a: np.ndarray, b: np.ndarray, need: int) -> np.ndarray:
    """Which signatures of ``a`` and ``b`` agree in ``need`` coordinates."""
    near = np.zeros((len(a), len(b)), bool)
    step = max(1, (16 << 20) // max(1, b.size))
    for s in range(0, len(a), step):
        near[s: s + step] = (a[s: s + step, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int16) >= need
    return near


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, from products of their incidence matrices."""
    value = np.concatenate(a + b)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
    width = 4096
    for low in range(0, int(column[-1]) + 1, width):
        x, y = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(a) + len(b), width), np.float32)
        dense[owner[x:y], column[x:y] - low] = 1
        out += dense[: len(a)] @ dense[len(a):].T
    return out


def _emitted(pairs: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def batch():
        columns = np.array(held, np.int64).reshape(-1, 2)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns.min(axis=1, initial=np.iinfo(np.int64).max)), pa.array(columns.max(axis=1, initial=np.iinfo(np.int64).min))], ["a", "b"])

    for pair in pairs:
        held.append(pair)
        if len(held) >= 20_000:
            yield batch()
    yield batch()


def _sides(table: pa.Table) -> tuple[bool, np.ndarray, np.ndarray]:
    inner = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    left = table.column("is_left").to_numpy(zero_copy_only=False).astype(bool)
    every = np.arange(len(left))
    return inner, every if inner else every[left], every if inner else every[~left]


def _may_link(need: int, percent: int):
    """Stars, list by list and tile by tile, of the documents that collide often enough."""

    def pairs(batches):
        for table in _groups(batches, ["key", "i", "j"]):
            inner, a, b = _sides(table)
            if not len(a) or not len(b):
                continue
            cid, n = (table.column(c).to_numpy() for c in ("cid", "n"))
            packed = np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint8).reshape(len(cid), -1)
            near = _fits_size(n[a], n[b], percent) & _collide(packed[a], packed[b], need)
            if inner:
                np.fill_diagonal(near, False)
            node = cid if inner else np.concatenate((cid[a], cid[b]))
            yield from _stars(near, inner, node)

    return lambda batches: _emitted(pairs(batches))


def _do_link(percent: int):
    """Stars, tile by tile of a cluster, of the documents whose whole sets are similar enough."""

    def pairs(batches):
        for table in _groups(batches, ["cluster", "i", "j"]):
            inner, a, b = _sides(table)
            if not len(a) or not len(b):
                continue
            cid, comp = (table.column(c).to_numpy() for c in ("cid", "comp"))
            lists = table.column("shingles").combine_chunks()
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            sets = [values[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
            n = np.diff(bounds)
            both = _common([sets[x] for x in a], [sets[x] for x in b]).astype(np.int64)
            near = 100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)
            if inner:
                np.fill_diagonal(near, False)
            near &= comp[a][:, None] != comp[b][None, :]
            node = cid if inner else np.concatenate((cid[a], cid[b]))
            yield from _stars(near, inner, node)

    return lambda batches: _emitted(pairs(batches))


def _cells(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """Every pair of tiles of a group, with the rows of both; a group of ``tiles`` tiles has each row so often."""
    tile = F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")
    cells = rows.withColumn("t", tile).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return cells.select(group, F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), (F.col("t") <= F.col("o")).alias("is_left"), "cid", *columns)


def _pairs(cells: DataFrame, group: str, finder) -> DataFrame:
    spread = cells.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")
    return spread.mapInArrow(finder, "a long, b long").distinct()


def _components(links: DataFrame) -> DataFrame:
    found = connected_components(links, "a", "b", as_text=False)
    return found.select(F.col("id").alias("cid"), F.col("cluster_id").alias("comp"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, component_id, kept)`` for every row of ``docs`` (``doc_id``, ``text``).

    The set of a document is its distinct runs of ``size`` words (A-Z lower-cased, words are runs of characters other
    than blanks and the controls 9 to 13); with fewer words the whole sequence is the one member. Documents with
    ``100 * common >= percent * union`` are linked; ``component_id`` is the smallest ``doc_id`` reachable over links.

    * Null or empty text, or text without words: an empty set, linked with nothing, kept.
    * Equal sets (copies, repeated rows): one class; classes are what lists hold, so copies cost one row each.
    * A null ``doc_id`` never names a component while another member has an id.
    * An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    need, need_all = collisions_needed(POSTED, percent), collisions_needed(COORDINATES, percent)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = materialize(texts.mapInArrow(
        _signer(size), "doc_id long, text_hash long, n_shingles long, cid long, sig array<int>, packed binary"))
    classes = signed.filter("cid IS NOT NULL").groupBy("cid").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("packed").alias("packed"))
    class_path, set_path = (scratch_path(spark, x) for x in ("classes", "sets"))
    classes = materialize(classes, path=class_path)

    keys = classes.select("cid", F.posexplode("sig").alias("c", "v")).select("cid", F.xxhash64("c", "v").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = (
        keys.join(shared.hint("shuffle_hash"), "key").groupBy("cid")
        .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("lists")).filter(F.size("lists") >= need)
        .select("cid", F.explode(F.expr(f"slice(lists, 1, size(lists) - {need} + 1)")).alias("l")).select("cid", F.col("l.key").alias("key"))
    )
    posted = materialize(ranked)
    lengths = posted.groupBy("key").agg(F.count("*").alias("length")).filter("length > 1")
    lists = posted.join(lengths, "key").select("key", "cid", F.ceil(F.col("length") / TILE).cast("int").alias("tiles"))
    posts = lists.join(classes.select("cid", "n", "packed"), "cid")
    maybe = materialize(_pairs(_cells(posts, "key", "n", "packed"), "key", _may_link(need_all, percent)))
    clusters = materialize(_components(maybe).select("cid", F.col("comp").alias("cluster")))

    wanted = materialize(clusters.join(classes.select("cid", "first_id"), "cid").select(F.col("cid").alias("want"), "first_id"))
    member = texts.join(narrow(wanted), F.col("doc_id").eqNullSafe(F.col("first_id"))).select("want", "text")
    sets = member.mapInArrow(_set_reader(size), "want long, cid long, shingles array<long>").filter("want = cid").select("cid", "shingles")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / SET_TILE).cast("int").alias("tiles"))
    sets = materialize(sets.dropDuplicates(["cid"]).join(clusters.join(sizes, "cluster"), "cid"), path=set_path)

    cells = _cells(sets.withColumn("comp", F.col("cid")), "cluster", "comp", "shingles").filter("i = j OR i = 0")
    links = materialize(_pairs(cells, "cluster", _do_link(percent)))
    comps = materialize(_components(links))
    many = sets.filter("tiles > 2")
    if not many.isEmpty():
        tiled = many.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        parted = tiled.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("cluster")
        cells = _cells(tiled.join(parted, "cluster", "left_semi"), "cluster", "comp", "shingles").filter("i < j AND i > 0")
        more = materialize(_pairs(cells, "cluster", _do_link(percent)))
        if not more.isEmpty():
            comps = _components(links.unionByName(more))

    ids = signed.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("first_id"))
    ids = ids.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    roots = ids.groupBy("comp").agg(F.min("first_id").alias("root"))
    roots = materialize(ids.join(roots, "comp").select("cid", "root"))
    release(spark, class_path, set_path)
    found = signed.select("doc_id", "text_hash", "n_shingles", "cid").join(roots, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    return found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of near duplicates stays; all columns as they are.

    The document with the smallest ``doc_id`` stays, and of repeated rows (equal id and text) one.
    """
    found = materialize(near_duplicates(docs, size, percent))
    repeated = found.filter("kept AND n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).filter("rows > 1")
    gone = found.filter("NOT kept").select("doc_id", "text_hash").distinct().withColumn("fate", F.lit(0))
    fates = materialize(gone.unionByName(repeated.select("doc_id", "text_hash", F.lit(1).alias("fate"))))
    fates = fates.select(F.col("doc_id").alias("_fate_id"), F.col("text_hash").alias("_fate_text"), F.col("fate").alias("_fate"))
    same = docs["doc_id"].eqNullSafe(F.col("_fate_id")) & (F.xxhash64(docs["text"]) == F.col("_fate_text"))
    marked = docs.join(narrow(fates), same, "left")
    single = marked.filter("_fate IS NULL").select(*[docs[c] for c in docs.columns])
    twice = marked.filter("_fate = 1").select(*[docs[c] for c in docs.columns]).dropDuplicates(["doc_id", "text"])
    return single.unionByName(twice)
