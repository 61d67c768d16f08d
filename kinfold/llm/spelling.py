"""Spelling variants of a corpus's words, found in a trie over counts of letter groups.

A word is the vector of how many of its letters fall into each of sixteen groups. One inserted letter adds one to one
count, one deleted letter takes one away, one replaced letter does both at most. So the words near a word lie at the
leaves of a trie over successive counts that a depth-first search reaches with a budget of one surplus and one deficit;
the words of the leaves it reaches are verified letter by letter. Nearness goes both ways, so a search spends its surplus
before its deficit and meets each pair once: from the shorter word, or from the one with fewer letters in the first group
in which both differ, or from the smaller of two words with equal counts.

The trie is dealt over tasks by its upper part: a prefix of counts with many words below it is split at the next count,
until each tile holds a bounded number. A word is looked up in every tile the search reaches, and each tile hands back
how many near words a word has there and the most frequent one, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LETTERS = "A-Za-zÀ-ÿ"
GROUPS = 16
#: Words of a tile, and of a leaf above the last count; a split prefix has more.
TILE = 8192
LEAF = 3
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def runs(text: Column) -> Column:
    """All maximal runs of letters of a text, A-Z in lower case; null for a null text."""
    return F.split(F.translate(text, _CAPITALS, _CAPITALS.lower()), f"[^{LETTERS}]+")


def dented(doc_id: Column, run: Column, every: int = 97) -> Column:
    """``run`` without one letter where the checksum of id and run is a multiple of ``every``; a null id is an empty one."""
    check = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(check, F.length(run).cast("long")).cast("int")
    return F.when(check % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_letters: int = 5, least_n: int = 3, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: the runs of letters of all texts with that many letters and occurrences.

    ``every`` first takes a letter out of each run whose checksum with its document's id is a multiple of it.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode(runs(F.col(text_col))).alias("run")).filter(F.length("run") >= least_letters)
    word = F.col("run") if every is None else dented(F.col("doc_id"), F.col("run"), every)
    counted = words.select(word.alias("word")).filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_n)


def vectors(words: list[str]) -> np.ndarray:
    """Counts of the letter groups of each word; the group of a letter is its code point modulo their number."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % GROUPS
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * GROUPS + letters, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


class Trie:
    """Words by the counts of their letter groups: inner nodes are dicts from count to node, leaves lists of places.

    A node with few words is a leaf at once, since checking them costs less than going on.
    """

    def __init__(self, words: list[str], leaf: int = LEAF):
        self.words, self.leaf = words, leaf
        self.counts = vectors(words).tolist()
        self.root = self._node(list(range(len(words))), 0)

    def _node(self, places: list[int], depth: int) -> dict | list:
        if depth == GROUPS or len(places) <= self.leaf:
            return places
        parts: dict[int, list[int]] = {}
        for place in places:
            parts.setdefault(self.counts[place][depth], []).append(place)
        return {count: self._node(below, depth + 1) for count, below in parts.items()}

    def near(self, word: str, counts: list[int]) -> list[int]:
        """Places of the words one edit away that this side of the pair has to find."""
        found, stack = [], [(self.root, 0, 1, 1)]
        head, tail = word[:len(word) // 2], word[len(word) // 2:]  # one edit leaves one of them as it is
        while stack:
            node, depth, surplus, deficit = stack.pop()
            if type(node) is list:
                for place in node:
                    other = self.words[place]
                    if (other.startswith(head) or other.endswith(tail)) and _finds(word, counts, other, self.counts[place]) and one_edit(word, other):
                        found.append(place)
                continue
            own = counts[depth]
            below = node.get(own)
            if below is not None:
                stack.append((below, depth + 1, surplus, deficit))
            if surplus:
                below = node.get(own + 1)
                if below is not None:
                    stack.append((below, depth + 1, 0, 1))
            elif deficit:
                below = node.get(own - 1)
                if below is not None:
                    stack.append((below, depth + 1, 0, 0))
        return found


def _finds(word: str, counts: list[int], other: str, others: list[int]) -> bool:
    """Whether the search from ``word`` is the one that meets ``other``: a word one letter longer, or as long and after it."""
    return len(other) == len(word) + 1 or (len(other) == len(word) and (others, other) > (counts, word))


def _prefixes(words: pa.Array) -> pa.Array:
    own = [list(accumulate((f"{c}." for c in counts), initial="")) for counts in vectors(words.to_pylist()).tolist()]
    return pa.array(own, pa.list_(pa.string()))


def _crowded(words: DataFrame, tile: int) -> dict[str, int]:
    """Prefixes of counts with more than ``tile`` words below them, and how many.

    The prefixes of one length share the words, so there are at most ``GROUPS + 1`` times words / ``tile`` of them.
    """
    prefixes = F.arrow_udf(_prefixes, "array<string>")
    many = words.select(F.explode(prefixes("word")).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("words")).filter(F.col("words") > tile)
    return {r["prefix"]: r["words"] for r in many.collect()}


def _tiles(crowded: dict[str, int], counts: list[int], budget: int, tile: int) -> list[tuple[str, int]]:
    """Tiles a search from ``counts`` reaches with ``budget`` surplus and deficit, and into how many parts each is cut."""
    found, stack = [], [("", 0, budget, budget)]
    while stack:
        key, depth, surplus, deficit = stack.pop()
        if key not in crowded or depth == GROUPS:
            found.append((key, -(-crowded.get(key, 1) // tile)))
            continue
        own = counts[depth]
        stack.append((f"{key}{own}.", depth + 1, surplus, deficit))
        if surplus:
            stack.append((f"{key}{own + 1}.", depth + 1, 0, deficit))
        elif deficit and own:
            stack.append((f"{key}{own - 1}.", depth + 1, 0, 0))
    return found


def _placed(shared, tile: int):
    """Each word once in its own tile, and as a question in every tile its search reaches."""
    schema = pa.schema([("tile", pa.string()), ("asks", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            rows: list[tuple] = []
            for word, count, counts in zip(words, n, vectors(words).tolist()):
                (home, parts), = _tiles(shared.value, counts, 0, tile)
                rows.append((f"{home}/{sum(map(ord, word)) * 31 % parts if parts > 1 else 0}", False, word, count))
                rows += [(f"{key}/{part}", True, word, count) for key, parts in _tiles(shared.value, counts, 1, tile) for part in range(parts)]
            if rows:
                yield _rows(rows, schema)

    return run


class _Tile:
    """The words of a tile, and for each how many near words asked here and the most frequent of them."""

    def __init__(self, held: list[tuple[str, int]]):
        self.trie = Trie([w for w, _ in held])
        self.n = [n for _, n in held]
        self.near, self.best = [0] * len(held), [(0, "")] * len(held)

    def ask(self, word: str, n: int, counts: list[int]) -> tuple | None:
        """What ``word`` finds; the words found take note of it."""
        found, best = self.trie.near(word, counts), None
        for place in found:
            self.near[place] += 1
            self.best[place] = min(self.best[place], (-n, word))
            own = (-self.n[place], self.trie.words[place])
            best = own if best is None else min(best, own)
        return (word, len(found), -best[0], best[1]) if best else None

    def noted(self) -> list[tuple]:
        return [(word, near, -best[0], best[1]) for word, near, best in zip(self.trie.words, self.near, self.best) if near]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by tile, its own words first; they make the trie, and the words that ask pass by."""
    tile, held, made = None, [], None
    for batch in batches:
        tiles, asks, words, n = (batch.column(c).to_pylist() for c in ("tile", "asks", "word", "n"))
        counts = vectors(words).tolist()
        rows: list[tuple] = []
        for i, word in enumerate(words):
            if tiles[i] != tile:
                rows += made.noted() if made else []
                tile, held, made = tiles[i], [], None
            if not asks[i]:
                held.append((word, n[i]))
            elif held:
                made = made or _Tile(held)
                found = made.ask(word, n[i], counts[i])
                if found:
                    rows.append(found)
        if rows:
            yield _rows(rows, _FOUND)
    if made and (rows := made.noted()):
        yield _rows(rows, _FOUND)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``(word, n_near, form_n, form)`` for every word one edit away from another of ``words`` (``word, n``, settled).

    ``form`` is the near word of largest ``n``, among equals the smallest in code-point order, and ``form_n`` its ``n``.
    """
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(_crowded(words, tile))
    placed = words.select("word", "n").mapInArrow(_placed(shared, tile), "tile string, asks boolean, word string, n long")
    dealt = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tile")
    found = dealt.sortWithinPartitions("tile", "asks").mapInArrow(_searched, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return merged.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for rows ``(word, form)`` (settled): the last word of the chain of forms that begins at ``word``.

    Every round doubles the links a row stands for. A form has at least twice its word's occurrences, so a chain has no
    circle and at most as many links as the largest number has binary digits.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        on = reached.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = reached.join(on, F.col("root") == F.col("at"), "left")
        reached = materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if reached.filter("moved").isEmpty():
            return reached.drop("moved")
        reached = reached.drop("moved")


def spelling_groups(words: DataFrame, times: int = 2, tile: int = TILE) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``words`` (``word, n``, each word once).

    ``form`` is the near word of largest ``n`` if that is at least ``times`` the word's own, else null with ``form_n``;
    ``root`` is the end of the chain of forms, the word itself without one; ``n_near`` is 0 for a word without near
    words. Words are told apart by their code points. Words of any length take part; empty words and null rows are left
    out. No words give no rows. Other columns are ignored.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")).filter("word <> '' AND n IS NOT NULL"), spread_by="word")
    near = words.join(near_words(words, tile), "word", "left")
    taken = F.col("form_n") >= times * F.col("n")
    formed = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n")))
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
