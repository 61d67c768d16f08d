"""I-Match fingerprints over randomised lexicon subsets, and their likeness.

The lexicon is the terms within a band of inverse document frequency over the distinct texts. Its size is bounded whatever
the size of the corpus: no more terms than ``mean distinct terms / LOW`` can be in a share of ``LOW`` of the documents,
so it is broadcast. Each subset keeps a pseudo-random share of the lexicon; the distinct terms of a text in the subset,
sorted, are hashed. An edit leaves a hash alone if it touches no term of its subset, so subsets come in several
densities: for a text of any length some hold only a few of its terms.

A text with few terms of the lexicon is printed by all its terms in some subsets: in those whose bound is above the share
of its terms that are in the lexicon. The bounds differ between the subsets, so of a text and its edited text, whose
shares are near each other, most subsets take the same kind of terms.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import materialize

from . import tokens as T
from .sides import narrow

#: Shares of documents between which a term is in the lexicon (idf of 2.3 to 6.9).
LOW, HIGH = 0.001, 0.1
_SUBSETS = 16
_SHIFTS = (1, 3, 5, 7, 9, 11)
_PARTS = _SUBSETS * len(_SHIFTS)
#: Share of a text's terms in the lexicon below which a subset takes all its terms; a text counts as having six at least.
_FULL = np.arange(1, _SUBSETS + 1) / (2 * _SUBSETS)
_FEW = 6
_BUCKET = 4096
_PIECE = 2 << 20


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the lower-cased words of each text, and where each text's begin."""
    data, offsets = T.buffers(texts)
    found = T.words(T.lower(data), offsets)
    return T.distinct(found.hash, found.first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def flush():
        names, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([h[1] for h in held]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], ["term", "n"])

    for whole in batches:
        for batch in T.slices(whole):
            terms, first = _terms(batch.column("text"))
            names, where = np.unique(terms, return_inverse=True)
            held.append((names, np.bincount(where, np.repeat(batch.column("share").to_numpy(), np.diff(first)), len(names))))
            rows += len(names)
            if rows > 2_000_000:
                yield flush()
                rows = 0
    if held:
        yield flush()


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms in the band, at least in two texts, counted over the distinct texts of ``docs``.

    Each of ``n`` copies of a text counts as a share of ``1 / n``, so texts stay where they are.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    copies = materialize(texts.groupBy(F.xxhash64("text").alias("hash")).agg(F.count("*").alias("copies")))
    total = copies.count()
    repeated = narrow(copies.filter("copies > 1"))
    shares = texts.join(repeated, F.xxhash64("text") == F.col("hash"), "left").select("text", F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("share"))
    counts = shares.mapInArrow(_count, "term long, n double").groupBy("term").agg(F.round(F.sum("n"), 6).alias("n"))
    banded = counts.filter((F.col("n") >= max(2.0, LOW * total)) & (F.col("n") <= max(2.0, HIGH * total))).select("term").toArrow()
    return np.sort(banded.column("term").to_numpy().view(np.uint64)) if banded.num_rows else np.zeros(0, np.uint64)


def prints(texts: pa.Array, banded: np.ndarray) -> np.ndarray:
    """A row of ``_PARTS`` 24-bit hashes for each text; 0 where it has no term in a subset.

    A text without a term of the lexicon is printed by all its terms, one with few of them by all its terms in some
    subsets, one without any term by zeros.
    """
    terms, first = _terms(texts)
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    if len(banded):
        at = np.minimum(np.searchsorted(banded, terms), len(banded) - 1)
        inside = banded[at] == terms
    else:
        inside = np.zeros(len(terms), bool)
    share = (np.bincount(doc[inside], minlength=n) / np.maximum(np.diff(first), _FEW))[doc]
    share[inside] = 1.0
    some = share < _FULL[-1]
    some |= inside
    terms, doc, share = terms[some], doc[some], share[some]
    inside = share == 1.0
    out = np.zeros((n, _PARTS), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(_SUBSETS):
            taken = inside | (share < _FULL[j])
            rank = T.mix(terms[taken] ^ np.uint64(0xA0761D6478BD642F * (j + 1) & (1 << 64) - 1))
            value, owner = T.mix(rank + np.uint64(j)), doc[taken]
            for k, shift in enumerate(_SHIFTS):
                keep = rank < np.uint64(1 << (64 - shift))
                rank, value, owner = rank[keep], value[keep], owner[keep]
                if not len(owner):
                    break
                new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                whole = T.mix(np.add.reduceat(value, new))
                out[owner[new], k * _SUBSETS + j] = (whole >> np.uint64(40)).astype(np.uint32) | np.uint32(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 0 to 1: of the densities with four subsets or more that hold a term of either text, the best share of equal
    hashes; of all subsets where there is no such density; 1 for equal prints."""
    shape = (len(a), len(_SHIFTS), _SUBSETS)
    a3, b3 = a.reshape(shape), b.reshape(shape)
    used = ((a3 > 0) | (b3 > 0)).sum(axis=2)
    same = ((a3 == b3) & (a3 > 0)).sum(axis=2)
    best = np.where(used >= 4, same / np.maximum(used, 1), 0).max(axis=1, initial=0)
    few = ~(used >= 4).any(axis=1)
    best[few] = (same.sum(axis=1) / np.maximum(used.sum(axis=1), 1))[few]
    best[(a == b).all(axis=1)] = 1.0
    return best


def hexed(parts: np.ndarray) -> list[str]:
    return [b"".join(b"%06x" % v for v in row).decode() for row in parts.tolist()]


def fingerprint(spark: SparkSession, text, banded: np.ndarray):
    """The fingerprint of a text as hexadecimal digits; null is an empty text."""
    shared = spark.sparkContext.broadcast(banded)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return T.by_slices(texts, lambda piece: pa.array(hexed(prints(piece, shared.value)), pa.string()), pa.string(), _PIECE)

    return run(text)


_RESULT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _edits(shared):
    """Rows of a cell come with the largest id first, before them the document after the cell; each meets the one after it."""

    def finish(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        banded = shared.value
        place: dict[int, int] = {}
        texts: list[str] = []

        def where(text: str) -> int:
            if id(text) not in place:
                place[id(text)] = len(texts)
                texts.append(text)
            return place[id(text)]

        own = [where(r[1]) for r in rows]
        after = [where(r[2]) for r in rows]
        edited = []
        for _, text, following in rows:
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + following[:cut])
        known = np.concatenate([prints(pa.array(texts[a: a + 500], pa.string()), banded) for a in range(0, len(texts), 500)])
        changed = np.concatenate([prints(pa.array(edited[a: a + 500], pa.string()), banded) for a in range(0, len(edited), 500)])
        mine = known[own]
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(hexed(mine)), pa.array(hexed(changed)),
            pa.array(likeness(mine, changed)), pa.array(likeness(mine, known[after])),
        ], _RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int | None, str, str]] = []
        size, current, smallest, following = 0, None, "", ""
        for whole in batches:
            for batch in T.slices(whole):
                for halo, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("halo", "doc_id", "text"))):
                    if halo:
                        current, smallest = _HALO, text
                        continue
                    if current is _HALO or doc_id != current:
                        following, smallest, current = smallest, text, doc_id
                    done.append((doc_id, text, following))
                    size += len(text)
                    if size > _PIECE:
                        yield finish(done)
                        done, size = [], 0
        if done:
            yield finish(done)

    return run


_HALO = object()


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest text of a task for each cell."""
    least: dict[int, str] = {}
    for whole in batches:
        for batch in T.slices(whole):
            for cell, text in zip(batch.column("cell").to_pylist(), batch.column("text").to_pylist()):
                if cell not in least or text < least[cell]:
                    least[cell] = text
    if least:
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array(list(least.values()), pa.string())], ["cell", "text"])


def _bounds(docs: DataFrame) -> tuple[list[int], list[int]]:
    """Where ranges of ids begin, and over how many cells each is dealt; the last range is that of the null ids.

    Ranges are cut by the number of rows. An id with the rows of several ranges is a range of its own, and only such a
    range, in which all rows have the same next document, is dealt over several cells.
    """
    n = docs.agg(F.count("doc_id").alias("ids"), F.count("*").alias("rows")).first()
    cells = max(1, n["ids"] // _BUCKET)
    cut = docs.agg(F.percentile_approx("doc_id", [i / cells for i in range(cells)], 10 * max(1000, cells)).alias("at")).first()["at"] or []
    often = Counter(cut)
    first = {i: 1 for i in cut}
    for i, times in often.items():
        if times > 1:
            first[i] = times
            if i < (1 << 63) - 1:
                first.setdefault(i + 1, 1)
    starts = sorted(first)
    return starts, [1, *(first[i] for i in starts), max(1, (n["rows"] - n["ids"]) // _BUCKET)]


def edited_prints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter gives way to the start of the next document.

    The next document is that with the next larger ``doc_id``, after the last the first; of rows with that id the one with
    the smallest text. Rows with equal ids have the same next document, rows with a null id stand together after the
    last. Null texts are empty. Texts move once, to a cell of their range of ids, in which they come with the largest id
    first: the next document is then known before a row is read. The document after a cell comes as one row before it.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(docs))
    starts, salts = _bounds(docs)
    edges, cells = np.array(starts, np.int64), np.array(salts, np.int64)
    offset = np.concatenate(([0], np.cumsum(cells)))
    null_range = len(cells) - 1

    @F.arrow_udf("long")
    def range_of(ids: pa.Array) -> pa.Array:
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(edges, known, "right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), null_range, at))

    @F.arrow_udf("long")
    def cell_of(ranges: pa.Array, row: pa.Array) -> pa.Array:
        k = ranges.to_numpy(zero_copy_only=False)
        return pa.array(offset[k] + row.to_numpy(zero_copy_only=False) % cells[k])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("range", range_of("doc_id"))
    # a row for each range: at most two for 4,096 documents and two more
    begin = {r["range"]: r["first_id"] for r in rows.groupBy("range").agg(F.min("doc_id").alias("first_id")).collect()}
    order = sorted(begin)
    opens = [(k, begin[k], order[i - 1]) for i, k in enumerate(order)]
    first = materialize(spark.createDataFrame(opens, "range long, first_id long, before long"))
    found = rows.join(narrow(first.withColumnRenamed("range", "_range")), (F.col("range") == F.col("_range")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    least = found.select(F.col("before").alias("cell"), "text").mapInArrow(_least, "cell long, text string").groupBy("cell").agg(F.min("text").alias("text"))
    dealt = spark.createDataFrame([(k, int(offset[k]), int(offset[k + 1]) - 1) for k in order], "range long, low long, high long")
    halo = least.join(F.broadcast(dealt), F.col("cell") == F.col("range")).select(
        F.explode(F.sequence("low", "high")).alias("cell"), F.lit(True).alias("halo"), F.lit(None).cast("long").alias("doc_id"), "text"
    )
    spread = rows.withColumn("cell", cell_of("range", F.monotonically_increasing_id())).select("cell", F.lit(False).alias("halo"), "doc_id", "text")
    ordered = spread.unionByName(halo).repartition("cell").sortWithinPartitions("cell", F.desc("halo"), F.desc("doc_id"), "text")
    return ordered.mapInArrow(_edits(shared), _RESULT_SQL)
