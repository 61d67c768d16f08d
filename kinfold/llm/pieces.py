"""SentencePiece encoding of whole texts from a merge-type prefix table, and decoding.

In a merge-type vocabulary a text has one valid segmentation: every piece is what its own merges make, and every pair of
neighbours is compatible, which means that merging the concatenation of both gives back the pair. So each prefix of a
text has a unique last token: the longest suffix piece that is compatible with the last token of the prefix before it.
The suffix pieces of all prefixes come from one run of an automaton; the table is filled forwards and read backwards.

Pieces never cross from a character to a following blank mark, nor into a line end, so texts are cut there, and a word
met again in a task is not worked out again.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import tokens as T

MARK = "▁"
#: Words (of ids, of digests) and pairs of pieces a Python worker keeps, and twice as many at most.
_KEPT_WORDS = {"ids": 150_000, "digests": 400_000}
_KEPT_PAIRS = 150_000
_DIGESTS = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class _Recent(dict):
    """What each key becomes, worked out when first asked for, in two generations.

    When the younger one is full it becomes the older and that one goes; a key found in the older moves over. So what is
    asked for again and again stays, and neither holds more than ``size`` keys. Very long keys are not kept.
    """

    def __init__(self, work: Callable, size: int):
        self.work, self.size, self.older = work, size, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.work(key)
            if len(key) > 100:
                return got
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


class Pieces:
    """The vocabulary of one SentencePiece model file of merge type, without pieces its merges cannot make."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as layout

        proto = layout.ModelProto()
        proto.ParseFromString(model)
        normal, kind = proto.normalizer_spec, proto.trainer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or kind.treat_whitespace_as_suffix or not kind.byte_fallback:
            raise ValueError("only models with identity normalisation, blank marks and byte fallback are supported")
        self.dummy_prefix = normal.add_dummy_prefix
        self.text = [p.piece for p in proto.pieces]
        self.id, self.score, self.byte = {}, {}, {}
        for i, p in enumerate(proto.pieces):
            if p.type == layout.ModelProto.SentencePiece.NORMAL:
                self.id[p.piece] = i
                self.score[p.piece] = p.score
            elif p.type == layout.ModelProto.SentencePiece.BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id):
            raise ValueError("a piece crosses from a character to a blank mark, or holds a line end")
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.compatible = _Recent(self._fit, _KEPT_PAIRS)
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            if len(piece) == 1 or self._merged(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        # for each piece the longest piece that is a proper suffix of it
        self.next_suffix = {}
        for piece in self.automaton.keys():
            self.next_suffix[piece] = next((piece[k:] for k in range(1, len(piece)) if piece[k:] in self.automaton), None)

    def _merged(self, text: str) -> list[str]:
        """Merge pairs of a short text, best score first and leftmost among equals, until none is left."""
        parts = list(text)
        after = list(range(1, len(parts))) + [-1]
        before = [-1, *range(len(parts) - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (whole := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[whole], i, j, whole))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or parts[j] is None or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _fit(self, pair: tuple[str, str]) -> bool:
        """Whether two pieces can stand side by side."""
        return self._merged(pair[0] + pair[1]) == [*pair]

    def tokens(self, word: str) -> list[str]:
        """The pieces of a run of characters; one outside the vocabulary stands as itself.

        ``last[k]`` is the last token of the first ``k`` characters. The automaton gives the longest piece that ends
        there, its chain of suffixes the others; the first that is compatible with the last token before it is it.
        """
        size = len(word)
        longest: list[str | None] = [None] * size
        for end, piece in self.automaton.iter(word):
            if longest[end] is None or len(piece) > len(longest[end]):
                longest[end] = piece
        last: list[str] = [""] * (size + 1)
        for k in range(1, size + 1):
            piece = longest[k - 1]
            while piece is not None:
                before = last[k - len(piece)]
                if not before or self.compatible[before, piece]:
                    break
                piece = self.next_suffix[piece]
            last[k] = piece if piece is not None else word[k - 1]
        out, k = [], size
        while k:
            out.append(last[k])
            k -= len(last[k])
        return out[::-1]

    def ids(self, word: str) -> list[int]:
        """Ids of a run of characters, with bytes for what the vocabulary lacks."""
        out = []
        for piece in self.tokens(word):
            known = self.id.get(piece)
            out.extend([known] if known is not None else [self.byte[b] for b in piece.encode("utf-8")])
        return out

    def plain(self, ids: list[int]) -> str:
        """The text of ids: blank marks are blanks, byte runs are UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.text[i].replace(MARK, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of all ids of a document; the blank put before it goes."""
        text = self.plain(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_CUT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def words(text: str, dummy_prefix: bool = True) -> list[str]:
    """The normalised text cut where no piece can cross: before each run of blank marks and around line ends."""
    if not text:
        return []
    return _CUT.findall((MARK if dummy_prefix else "") + text.replace(" ", MARK))


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> tuple[Pieces, dict]:
    return Pieces(model), {}


def _known_words(model: bytes, name: str, work: Callable[[Pieces, str], object]) -> tuple[Pieces, _Recent]:
    pieces, kinds = _loaded(model)
    return pieces, kinds.setdefault(name, _Recent(lambda word: work(pieces, word), _KEPT_WORDS[name]))


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _encoder(shared):
    def run(texts: pa.Array) -> pa.Array:
        pieces, known = _known_words(shared.value, "ids", lambda p, word: np.array(p.ids(word), np.int32).tobytes())
        found = [b"".join([known[word] for word in words(text.as_py() or "", pieces.dummy_prefix)]) for text in texts]
        ends = np.cumsum([0, *map(len, found)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32)))

    return run


def encode(spark: SparkSession, text: Column, model: bytes) -> Column:
    """``array<int>``: the ids of a text, without begin or end ids; none for a null or empty text."""
    work = _encoder(spark.sparkContext.broadcast(model))

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return T.by_slices(texts, work, pa.list_(pa.int32()))

    return run(text)


def _in_slices(work: Callable[[pa.Array], pa.Array], keep: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), work(batch.column("text"))], [*keep, "ids"])
                T.give_back()

    return run


def encoded(docs: DataFrame, keep: Sequence[str], model: bytes) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``ids``, handed back in small batches, which bounds memory for whole corpora."""
    run = _in_slices(_encoder(docs.sparkSession.sparkContext.broadcast(model)), keep)
    return docs.select(*keep, "text").mapInArrow(run, docs.select(*keep).schema.add("ids", ArrayType(IntegerType())))


def decode(spark: SparkSession, ids: Column, model: bytes) -> Column:
    """The text of an array of ids; null stays null."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        pieces, _ = _loaded(shared.value)
        return pa.array([None if r is None else pieces.decode(r) for r in rows.to_pylist()], pa.string())

    return run(ids)


def round_trip(spark: SparkSession, text: Column, model: bytes) -> Column:
    """``struct(n_tokens, ids_sha256, decoded_sha256)``: number and digest of the ids of a text (null: empty), decimal and
    joined by commas, and digest of what they decode to."""
    shared = spark.sparkContext.broadcast(model)

    def work(pieces: Pieces, word: str) -> tuple[int, str, str]:
        ids = pieces.ids(word)
        return len(ids), ",".join(map(str, ids)), pieces.plain(ids)

    def piece(texts: pa.Array) -> pa.Array:
        pieces, known = _known_words(shared.value, "digests", work)
        counts, ids, plain = [], [], []
        for text in texts:
            rows = [known[word] for word in words(text.as_py() or "", pieces.dummy_prefix)]
            back = "".join([r[2] for r in rows])
            if pieces.dummy_prefix and back.startswith(" "):
                back = back[1:]
            counts.append(sum([r[0] for r in rows]))
            ids.append(hashlib.sha256(",".join([r[1] for r in rows]).encode()).hexdigest())
            plain.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], fields=list(_DIGESTS))

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def run(texts: pa.Array) -> pa.Array:
        return T.by_slices(texts, piece, _DIGESTS)

    return run(text)
