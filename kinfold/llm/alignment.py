"""Alignment of two tokenizers by the byte offsets where tokens of both end.

Each document's cumulative token ends go into a dictionary from end to index, one for each tokenizer. The ends both have,
sorted, slice both id lists into groups; within a group every token of one side is linked with every token of the other.
How many documents hold a linked pair of ids is counted over the whole corpus, and each document's links are read against
these counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import tokens as T

#: Links of a document in one row, pairs of ids a batch works on at once, and pairs of ids whose counts are broadcast.
_LINKS_A_ROW = 1 << 17
_PAIRS_AT_ONCE = 1 << 20
BROADCAST_PAIRS = 500_000
MARK = "▁"

_LINK = pa.struct([("pair", pa.int64()), ("times", pa.int64())])
_ROWS = pa.schema([("row", pa.int64()), ("piece", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("groups_sha256", pa.string()), ("links", pa.list_(_LINK))])
_ROWS_SQL = "row long, piece int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, times: long>>, doc_id "


def byte_signs() -> dict[str, int]:
    """The byte of each sign of a byte-level vocabulary: printable bytes stand for themselves, the others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: How byte-level vocabularies cut a text before merging: fixed by the format.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WHITE = re.compile(r"\s{500}")


class ByteLevel:
    """A byte-level tokenizer file of the ``tokenizers`` library; strings of special tokens are plain text.

    Where ids rise in the order of the merges, as they do in vocabularies stored as ranks, ``tiktoken`` works out the same
    ids in a quarter of the time. Other files go through ``tokenizers``, and so do texts with long runs of white space,
    which ``tiktoken`` cannot cut.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        signs, made = byte_signs(), json.loads(definition)
        model, cut = made["model"], made["pre_tokenizer"]
        vocabulary = model["vocab"] | {t["content"]: t["id"] for t in made["added_tokens"]}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(signs[c] for c in piece) if all(c in signs for c in piece) else piece.encode()
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain = not odd and made["normalizer"] is None and (cut["type"], cut["add_prefix_space"], cut["use_regex"]) == ("ByteLevel", False, True)
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.ranked = None
        if plain and set(model["vocab"]) == {*signs, *merges} and all(model["vocab"][m] == 256 + i for i, m in enumerate(merges)):
            import tiktoken

            ranks = {self.bytes[i]: i for i in model["vocab"].values()}
            self.ranked = tiktoken.Encoding("ranks", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [(self._plain(t) if self.ranked is None or _WHITE.search(t) else self.ranked.encode_to_numpy(t)).astype(np.int64) for t in texts]

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)

    def spells(self, ids: np.ndarray, whole: bytes) -> bool:
        """Whether the ids make up these bytes. Ranks have every single byte and cut a text without leaving any out, so
        there the length tells."""
        if self.ranked is not None:
            return int(self.size[ids].sum()) == len(whole)
        return b"".join(map(self.bytes.__getitem__, ids.tolist())) == whole


class Marked:
    """A model file of the ``sentencepiece`` library; U+2581 is a space and ``<0xHH>`` a byte."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [self._piece(i) for i in range(self.model.get_piece_size())]
        self.size = np.array([len(b) for b in self.bytes], np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(MARK, " ").encode()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def read_tokenizers(byte_level: str, marked: str) -> tuple[str, bytes]:
    """The contents of both files, to be broadcast: a few MB whatever the corpus."""
    with open(byte_level, encoding="utf-8") as file:
        definition = json.dumps(json.load(file))
    with open(marked, "rb") as file:
        return definition, file.read()


@lru_cache(maxsize=2)
def _loaded(definition: str, model: bytes) -> tuple[ByteLevel, Marked]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return ByteLevel(definition), Marked(model)


def groups(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of each side lie before the end of each group, for ends that rise strictly.

    >>> groups([2, 5, 6], [1, 2, 6])
    ([1, 3], [2, 3])
    """
    at_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    at_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(at_a.keys() & at_b.keys())
    return list(map(at_a.__getitem__, common)), list(map(at_b.__getitem__, common))


def spelt(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, sizes: tuple[int, int]) -> str:
    """``a1,a2|b1;a3|b2,b3``: ids of each side, group by group. ``sizes`` are those of the vocabularies."""
    many_a, many_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[to_a - 1] = last_b[to_b - 1] = 1
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.repeat(to_b - many_b, many_a)] = 2 * a + last_a
    code[np.arange(len(b)) + np.repeat(to_a, many_b)] = 2 * (b + sizes[0]) + last_b
    names = _names(*sizes)
    return "".join(map(names.__getitem__, code.tolist()))[:-1]


@lru_cache(maxsize=2)
def _names(first: int, second: int) -> list[str]:
    """The ids of both vocabularies as they stand inside and at the end of their side of a group."""
    return [f"{i}{mark}" for i in range(first) for mark in ",|"] + [f"{i}{mark}" for i in range(second) for mark in ",;"]


def linked(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of linked ids, ``a`` in the upper half of a 64-bit value, and how many links each has.

    Groups are expanded in runs of about ``_PAIRS_AT_ONCE`` pairs and folded as they come; a group beyond that is
    expanded over its distinct ids, whose numbers are multiplied.
    """
    many_a, many_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    product = many_a * many_b
    pairs, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    upto = np.cumsum(product)
    start = 0
    while start < len(product):
        if product[start] > _PAIRS_AT_ONCE:
            own_a, n_a = np.unique(a[to_a[start] - many_a[start]: to_a[start]], return_counts=True)
            own_b, n_b = np.unique(b[to_b[start] - many_b[start]: to_b[start]], return_counts=True)
            step = max(1, _PAIRS_AT_ONCE // len(own_b))
            for k in range(0, len(own_a), step):
                pairs.append(((own_a[k: k + step, None] << 32) | own_b).ravel())
                times.append((n_a[k: k + step, None] * n_b).ravel())
            start += 1
            continue
        before = upto[start] - product[start]
        end = max(start + 1, int(np.searchsorted(upto, before + _PAIRS_AT_ONCE, side="right")))
        here = product[start:end]
        group = np.repeat(np.arange(start, end), here)
        place = np.arange(int(here.sum())) - np.repeat(np.cumsum(here) - here, here)
        at_a = to_a[group] - many_a[group] + place // many_b[group]
        at_b = to_b[group] - many_b[group] + place % many_b[group]
        found = (a[at_a] << 32) | b[at_b]
        found.sort()
        new = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        pairs.append(found[new])
        times.append(np.diff(new, append=len(found)))
        start = end
    if len(pairs) == 2:
        return pairs[1], times[1]
    found, back = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, back, np.concatenate(times))
    return found, total


def _aligner(shared):
    def one(text: str, a: np.ndarray, b: list[int], first: ByteLevel, second: Marked):
        whole = (" " + text).encode()
        if not text or not first.spells(a, whole) or b"".join(map(second.bytes.__getitem__, b)) != whole:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids_a, ids_b = a, np.array(b, np.int64)
        to_a, to_b = groups(np.cumsum(first.size[ids_a]).tolist(), np.cumsum(second.size[ids_b]).tolist())
        ends_a, ends_b = np.array(to_a, np.int64), np.array(to_b, np.int64)
        digest = hashlib.sha256(spelt(ids_a, ids_b, ends_a, ends_b, (len(first.bytes), len(second.bytes))).encode()).hexdigest()
        n_links = int((np.diff(ends_a, prepend=0) * np.diff(ends_b, prepend=0)).sum())
        return len(a), len(b), len(to_a), n_links, digest, *linked(ids_a, ids_b, ends_a, ends_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _loaded(*shared.value)
        for batch in (piece for whole in batches for piece in T.slices(whole)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            columns: list[list] = [[] for _ in range(7)]
            pairs, times, sizes, origin = [], [], [], []
            for i, (row, text, a, b) in enumerate(zip(batch.column("row").to_pylist(), texts, first.ids([" " + t for t in texts]), second.ids(texts))):
                *numbers, found, n = one(text, a, b, first, second)
                for piece in range(max(1, -(-len(found) // _LINKS_A_ROW))):
                    for column, value in zip(columns, [row, piece, *numbers]):
                        column.append(value)
                    origin.append(i)
                    cut = slice(piece * _LINKS_A_ROW, (piece + 1) * _LINKS_A_ROW)
                    pairs.append(found[cut])
                    times.append(n[cut])
                    sizes.append(len(pairs[-1]))
            links = pa.StructArray.from_arrays([pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times))], fields=list(_LINK))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            ids = batch.column("doc_id").take(pa.array(origin))
            made = [*(pa.array(c, t) for c, t in zip(columns, _ROWS.types)), pa.ListArray.from_arrays(offsets, links), ids]
            yield pa.RecordBatch.from_arrays(made, schema=_ROWS.append(pa.field("doc_id", ids.type)))

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n, best)``: in how many rows of the corpus a pair of ids is linked, and whether no pair of its first id has more."""
    counts = aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = materialize(counts)
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("first_id")).agg(F.max("n").alias("most"))
    # one row for each id of the first vocabulary
    marked = counts.join(F.broadcast(most), first == F.col("first_id"))
    return materialize(marked.select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _frequent(counts: DataFrame, rows: int) -> int:
    """The least number such that at most ``rows`` pairs are in that many documents or more; 1 if all may stay."""
    steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("pairs"))
    total, least = 0, None
    for step in steps.orderBy(F.desc("power")).collect():
        total += step["pairs"]
        if total > rows:
            break
        least = step["power"]
    else:
        return 1
    return 1 << 62 if least is None else 1 << least


def align(docs: DataFrame, byte_level: str, marked: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """``(documents, counts)`` for tokenizer files A (byte-level) and B (sentencepiece).

    ``documents``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row for each row of
    ``docs``. A encodes a space and the text, B the text; both without special tokens. Texts that are null or empty, or
    whose tokens of either side do not spell the space and the text, have zeros and an empty digest. ``counts``: ``pair,
    n, best``, where ``pair`` holds A's id above its lower 32 bits and B's in them. Repeated rows, rows with equal ids and
    rows with a null id are documents of their own. Ties for the highest count are all best. Texts of any length are one
    row of numbers, their links rows of 131,072. Other columns are ignored; an empty table gives empty frames.

    Counts of the most frequent pairs, at most ``frequent``, are broadcast; only links of rarer pairs are shuffled, so no
    pair that many documents share is a key of the shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_tokenizers(byte_level, marked))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = materialize(rows.mapInArrow(_aligner(shared), _ROWS_SQL + rows.schema["doc_id"].dataType.simpleString()))
    counts = pair_counts(held)
    least = _frequent(counts, frequent)
    links = held.select("row", F.explode("links").alias("link")).select("row", "link.pair", "link.times")
    known = F.broadcast(counts.filter(F.col("n") >= least))
    total = [F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    sums = links.join(known, "pair").groupBy("row").agg(*total)
    if least > 1:
        rare = links.join(known, "pair", "left_anti").join(counts.filter(F.col("n") < least), "pair").groupBy("row").agg(*total)
        sums = sums.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = held.filter("piece = 0").drop("links", "piece").join(sums, "row", "left")
    none = F.lit(0).cast("long")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"), counts
