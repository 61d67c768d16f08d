"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ``ORDER`` bytes holds how often each byte followed. A byte is coded in
the longest context that was seen; if it never followed there, an escape is coded and the next shorter context is asked,
without the bytes already ruled out (escape method C with exclusion). The statistics are frozen after training, so the
cost of a byte depends on it and the ``ORDER`` bytes before it only, and the code length of a whole text is the exact sum.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.session import materialize

from . import tokens as T
from .sides import narrow
from .toxicity import held_out

ORDER = 4
#: Labelled documents per language that the statistics come from, and the characters that are learnt of one.
SAMPLE_DOCS = 200
SAMPLE_CHARS = 20_000
_SALTS = 256
_SLOTS = 21
_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte the key of it and the ``ORDER`` bytes before it, the oldest first; 0 stands before a text."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = data.astype(np.uint64)
    for k in range(1, ORDER + 1):
        old = np.zeros(len(data), np.uint64)
        old[k:] = data[:-k] if k < len(data) else data[:0]
        old[place < k] = 0
        key |= old << np.uint64(8 * k)
    return key


@dataclass
class Tree:
    """Sorted contexts and (context, byte) pairs of each order with their counts; see ``grow``."""

    contexts: list[np.ndarray]
    total: list[np.ndarray]
    kinds: list[np.ndarray]
    above: list[np.ndarray]
    pairs: list[np.ndarray]
    count: list[np.ndarray]


def _find(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(names, wanted), max(len(names) - 1, 0))
    return at, names[at] == wanted if len(names) else np.zeros(len(wanted), bool)


def grow(keys: np.ndarray) -> Tree:
    """The tree of the bytes with these keys. ``above`` is, for a context, how often the bytes that followed it also
    followed the next shorter context: what an escape rules out there."""
    tree = Tree([], [], [], [], [], [])
    for k in range(ORDER + 1):
        pairs, count = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        contexts, where = np.unique(pairs >> np.uint64(8), return_inverse=True)
        tree.pairs.append(pairs)
        tree.count.append(count)
        tree.contexts.append(contexts)
        tree.total.append(np.bincount(where, count, minlength=len(contexts)))
        tree.kinds.append(np.bincount(where, minlength=len(contexts)))
        if k:
            at, _ = _find(tree.pairs[k - 1], pairs & np.uint64((1 << 8 * k) - 1))
            tree.above.append(np.bincount(where, tree.count[k - 1][at], minlength=len(contexts)))
        else:
            tree.above.append(np.zeros(len(contexts)))
    return tree


def code_lengths(tree: Tree, keys: np.ndarray) -> np.ndarray:
    """Bits each byte costs after the bytes before it."""
    bits = np.zeros(len(keys))
    out_total, out_kinds = np.zeros(len(keys)), np.zeros(len(keys))
    open_ = np.arange(len(keys))
    for k in range(ORDER, -1, -1):
        if not len(open_):
            break
        own = keys[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
        at, seen = _find(tree.contexts[k], own >> np.uint64(8))
        total = np.where(seen, tree.total[k][at] if len(tree.total[k]) else 0, 0) - out_total[open_]
        kinds = np.where(seen, tree.kinds[k][at] if len(tree.kinds[k]) else 0, 0) - out_kinds[open_]
        pair, hit = _find(tree.pairs[k], own)
        hit &= seen
        whole = total + kinds
        bits[open_[hit]] += np.log2(whole[hit] / tree.count[k][pair[hit]])
        escape = seen & ~hit & (kinds > 0)
        bits[open_[escape]] += np.log2(whole[escape] / kinds[escape])
        out_total[open_] = np.where(seen, tree.above[k][at] if len(tree.above[k]) else 0, 0)
        out_kinds[open_] = np.where(seen, tree.kinds[k][at] if len(tree.kinds[k]) else 0, 0)
        open_ = open_[~hit]
    bits[open_] += np.log2(np.maximum(256 - out_kinds[open_], 1))
    return bits


@dataclass
class Languages:
    """Names in order, a tree each, and the costs of contexts met so far: a table that only saves time."""

    names: list[str]
    trees: list[Tree]
    seen: np.ndarray | None = field(default=None, repr=False)
    cost: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"names": self.names, "trees": self.trees, "seen": None, "cost": None}

    def text_bits(self, texts: pa.Array) -> np.ndarray:
        """Code length of each text in each language (texts x languages)."""
        if self.seen is None:
            self.seen = np.full(1 << _SLOTS, np.uint64(1 << 63))
            self.cost = np.zeros((len(self.names), 1 << _SLOTS), np.float32)
        data, offsets = T.buffers(texts)
        keys = _keys(T.lower(data), offsets)
        with np.errstate(over="ignore"):
            slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        new = np.unique(keys[self.seen[slot] != keys])
        with np.errstate(over="ignore"):
            self_slot = ((new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        fresh = np.stack([code_lengths(tree, new) for tree in self.trees]).astype(np.float32) if len(new) else np.zeros((len(self.names), 0), np.float32)
        self.seen[self_slot] = new
        # of several new keys in a slot the last stays; its cost must be the one kept
        last = self.seen[self_slot] == new
        self.cost[:, self_slot[last]] = fresh[:, last]
        odd = np.flatnonzero(self.seen[slot] != keys)
        at = np.searchsorted(new, keys[odd])
        held = at < len(new)
        held[held] = new[at[held]] == keys[odd][held]
        out = np.zeros((len(texts), len(self.names)))
        late = np.flatnonzero(~held)
        for k in range(len(self.names)):
            each = self.cost[k][slot].astype(np.float64)
            each[odd[held]] = fresh[k][at[held]]
            if len(late):
                each[odd[late]] = code_lengths(self.trees[k], keys[odd[late]]).astype(np.float32)
            out[:, k] = T.fold(np.add, each, offsets, 0.0)
        return out


def train(docs: DataFrame) -> Languages:
    """Statistics from a bounded sample of the documents with a language that are not held out: the same in every run.

    Documents are chosen by the hash of their id, ``SAMPLE_DOCS`` a language. Those of up to ``SAMPLE_CHARS`` characters
    come first; a language that has too few of them is filled up with longer ones, of which the first ``SAMPLE_CHARS``
    characters are learnt. Of several texts with one id and language a short one counts before a long one, then the
    smallest. Columns beyond ``doc_id``, ``lang`` and ``text`` are never read; without any such document no language is
    learnt.
    """
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    known = known.select("lang", "doc_id", "text", (F.length("text") > SAMPLE_CHARS).alias("long"))
    ids = known.groupBy("lang", "doc_id").agg(F.min("long").alias("long")).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(_SALTS)))
    order = [F.col("long"), F.xxhash64("doc_id"), F.col("doc_id")]
    # ranked by salt first: no task meets the candidates of all tasks for one language
    first = ids.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= SAMPLE_DOCS)
    chosen = first.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= SAMPLE_DOCS).drop("salt")
    texts = known.join(narrow(materialize(chosen)), ["lang", "doc_id", "long"])
    sample = texts.groupBy("lang", "place").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text")).toArrow()
    sample = sample.sort_by([("lang", "ascending"), ("place", "ascending")])
    by_name: dict[str, list[str]] = {}
    for lang, text in zip(sample.column("lang").to_pylist(), sample.column("text").to_pylist()):
        by_name.setdefault(lang, []).append(text)
    trees = []
    for texts in by_name.values():
        data, offsets = T.buffers(pa.array(texts, pa.string()))
        trees.append(grow(_keys(T.lower(data), offsets)))
    return Languages(list(by_name), trees)


def language(spark: SparkSession, text: Column, model: Languages) -> Column:
    """``struct(lang, score)``: the language that codes the text in the fewest bits, ties to the first name, and its
    share of the likelihood. ``und`` with 0 where the text is null or has no letter, or no language was learnt."""
    shared = spark.sparkContext.broadcast(model)

    def piece(texts: pa.Array) -> pa.Array:
        bits = shared.value.text_bits(texts)
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array([shared.value.names[k] for k in best], pa.string()), pa.array(score)], fields=list(_RESULT))

    @F.arrow_udf("struct<lang: string, score: double>")
    def guess(texts: pa.Array) -> pa.Array:
        return T.by_slices(texts, piece, _RESULT)

    unknown = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    if not model.names:
        return unknown
    return F.when(F.coalesce(text.rlike("\\p{L}"), F.lit(False)), guess(text)).otherwise(unknown)
