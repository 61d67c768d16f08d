"""Upper bounds of text similarities from letter counts, and joins that lose no pair above a threshold.

Every similarity here needs common letters: with ``o`` letters in common (as multisets), Jaro is at most
``(o/|a| + o/|b| + 1) / 3``, and the edit similarity at most ``o / max(|a|, |b|)``. The letters of a text are marked once
in 256 bits, a bit for each letter and how often it came before; each bit set on one side only is a letter the other
lacks, so the bound of a pair is a few word operations inside a join condition, and only pairs that may reach the
threshold go through the similarity itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import materialize
from .pairing import ROWS_PER_TILE, tiled_join

_EPSILON = 1e-9
_WORDS = ("w0", "w1", "w2", "w3")
_MARKS = pa.struct([("n", pa.int32()), *((w, pa.int64()) for w in (*_WORDS, "head"))])
_POSTED = pa.struct([("few", pa.list_(pa.string())), ("many", pa.list_(pa.string()))])
#: Letters from rare to frequent in names of European languages; others count as rarer. Any order gives the same pairs.
_RARE_FIRST = "qxzjwvyfkpgbcmuhdlotsrinea "


def _tokens(text: str) -> list[tuple[str, int]]:
    """Each letter with how often it came before."""
    seen: dict[str, int] = {}
    out = []
    for letter in text:
        out.append((letter, seen.get(letter, 0)))
        seen[letter] = out[-1][1] + 1
    return out


@F.arrow_udf(StructType([StructField("n", IntegerType()), *(StructField(w, LongType()) for w in (*_WORDS, "head"))]))
def marks(texts: pa.Array) -> pa.Array:
    """Length, letter bits and the first four letters of a text, 15 of 16 bits each; null for null."""
    rows = []
    for text in texts.to_pylist():
        if text is None:
            rows.append(None)
            continue
        bits = 0
        for letter, before in _tokens(text):
            bits |= 1 << ((ord(letter) * 7 + before * 67) % 256)
        head = b"".join((ord(letter) & 0x7FFF).to_bytes(2, "little") for letter in text[:4])
        rows.append({"n": len(text), "head": int.from_bytes(head.ljust(8, b"\0"), "little", signed=True)} | {w: int.from_bytes(bits.to_bytes(32, "little")[8 * k: 8 * k + 8], "little", signed=True) for k, w in enumerate(_WORDS)})
    return pa.array(rows, _MARKS)


def marked(df: DataFrame, texts: Mapping[str, Column]) -> DataFrame:
    """Add the marks of texts as columns of their own, ``<prefix>_n`` and so on, none of them null, for ``..._upto``.

    ``n`` is -1 for a null text. ``spare`` is what the letters are more than the bits they set, ``share`` is ``1 / n``.
    """
    df = df.withColumns({prefix: marks(text) for prefix, text in texts.items()})
    columns = {}
    for prefix in texts:
        m = F.col(prefix)
        columns[f"{prefix}_n"] = F.coalesce(m["n"], F.lit(-1))
        columns[f"{prefix}_spare"] = F.coalesce(m["n"] - reduce(lambda s, t: s + t, [F.bit_count(m[w]) for w in _WORDS]), F.lit(0))
        columns[f"{prefix}_share"] = F.when(m["n"] > 0, 1.0 / m["n"]).otherwise(0.0)
        columns |= {f"{prefix}_{w}": F.coalesce(m[w], F.lit(0).cast("long")) for w in (*_WORDS, "head")}
    return df.withColumns(columns).drop(*texts)


def mark_columns(prefix: str, side: str = "") -> dict[str, Column]:
    """The columns ``marked`` has added, by what they are."""
    return {c: F.col(f"{prefix}_{c}{side}") for c in ("n", "spare", "share", *_WORDS, "head")}


def _common(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """``overlap`` of marked columns."""
    return reduce(lambda s, t: s + t, [F.bit_count(a[w].bitwiseAND(b[w])) for w in _WORDS]) + F.least(a["spare"], b["spare"])


def levenshtein_upto(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """``levenshtein_bound`` of two texts that are not empty."""
    return _common(a, b) / F.greatest(a["n"], b["n"])


def jaro_winkler_upto(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """``jaro_winkler_bound`` of two texts that are not empty.

    The lowest bit in which the first letters differ tells how many of them, of 16 bits each, are the same.
    """
    differ = a["head"].bitwiseXOR(b["head"])
    alike = F.shiftright(F.bit_count(differ.bitwiseAND(-differ) - 1), 4)
    return 1.0 - (2.0 - _common(a, b) * (a["share"] + b["share"])) / 3.0 * (1.0 - 0.1 * alike)


def overlap(a: Column, b: Column) -> Column:
    """At most how many letters two marked texts have in common."""
    lacks = lambda x, y: reduce(lambda s, t: s + t, [F.bit_count(x[w].bitwiseAND(F.bitwise_not(y[w]))) for w in _WORDS])
    return F.least(a["n"] - lacks(a, b), b["n"] - lacks(b, a))


def _guarded(a: Column, b: Column, bound: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 0.0).when((a["n"] == 0) & (b["n"] == 0), 1.0).when((a["n"] == 0) | (b["n"] == 0), 0.0).otherwise(bound)


def levenshtein_bound(a: Column, b: Column) -> Column:
    """Upper bound of the edit similarity of two marked texts: every letter not in common costs an edit."""
    return _guarded(a, b, overlap(a, b) / F.greatest(a["n"], b["n"]))


def _by_prefix(a: Column, b: Column, value: Callable[[float], float]) -> Column:
    """``value`` of what Jaro-Winkler adds for the common start, never less than it does, from the marks."""
    differ = a["head"].bitwiseXOR(b["head"])
    upto = lambda k: differ.bitwiseAND(F.lit((1 << 16 * k) - 1)) != 0
    return F.when(upto(1), value(0.0)).when(upto(2), value(0.1)).when(upto(3), value(0.2)).when(differ != 0, value(0.3)).otherwise(value(0.4))


def jaro_winkler_bound(a: Column, b: Column, text_a: Column | None = None, text_b: Column | None = None) -> Column:
    """Upper bound of Jaro-Winkler of two marked texts, with the prefix they really share if the texts are given.

    The letters are counted in one place of the expression: a condition of many is more than the JVM compiles.
    """
    prefix = _by_prefix(a, b, lambda p: p)
    if text_a is not None:
        head = lambda k: F.substring(text_a, 1, k) == F.substring(text_b, 1, k)
        prefix = F.when(~head(1), 0.0).when(~head(2), 0.1).when(~head(3), 0.2).when(~head(4), 0.3).otherwise(0.4)
    away = (2.0 - overlap(a, b) * (1.0 / a["n"] + 1.0 / b["n"])) / 3.0
    return _guarded(a, b, 1.0 - away * (1.0 - prefix))


def jaro_winkler_reaches(a: Column, b: Column, threshold: float) -> Column:
    """Whether Jaro-Winkler of two marked texts that are not null can reach ``threshold``."""
    share = lambda p: 3.0 * max((threshold - p) / (1.0 - p), min(threshold, 0.7)) - 1.0 - 3.0 * _EPSILON
    least = _by_prefix(a, b, share)
    return F.when((a["n"] == 0) | (b["n"] == 0), (a["n"] == b["n"]) | F.lit(threshold <= 0)).otherwise(overlap(a, b) * (1.0 / a["n"] + 1.0 / b["n"]) >= least)


def _share(threshold: float) -> float:
    """What ``m/|a| + m/|b|`` must be for Jaro-Winkler to reach the threshold without a common first letter, ``m`` letters matching."""
    return 3.0 * threshold - 1.0


def posted(text: Column, threshold: float) -> Column:
    """Letters a text is posted under as the shorter (``few``) and the longer side (``many``) of a pair, rarest first.

    Texts of ``n`` and ``L >= n`` letters that reach the threshold without a common first letter have at least
    ``share * n / 2`` and at least ``(share - 1) * L`` letters in common. Of two multisets with ``o`` members in common, the
    first ``n - o + 1`` of one and the first ``L - o + 1`` of the other in any fixed order share a member.
    """
    share = _share(threshold)

    @F.arrow_udf("struct<few: array<string>, many: array<string>>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts.to_pylist():
            tokens = sorted(_tokens(value or ""), key=lambda t: (_RARE_FIRST.find(t[0]) - 8 * t[1], t))
            n = len(tokens)
            least = [max(1, math.ceil(part * n - _EPSILON)) for part in (share / 2, share - 1)]
            rows.append({name: [f"{c}{k}" for c, k in tokens[: n - o + 1]] for name, o in zip(("few", "many"), least)})
        return pa.array(rows, _POSTED)

    return run(text)


def jaro_winkler_candidates(df: DataFrame, group: Sequence[str], id_col: str, text_col: str, threshold: float, rows_per_tile: int = ROWS_PER_TILE,
                            asked: DataFrame | None = None) -> DataFrame:
    """``(*group, id_a, text_a, id_b, text_b)``: all pairs of a group whose Jaro-Winkler may reach ``threshold``.

    ``df`` has one row for each id, with texts that are not null; equal texts are pairs too. Pairs with a common first
    letter meet under it; the others need more letters in common and meet under the rare ones they are posted under, and
    go on from the first of these. A letter of very many texts is spread over a grid of tiles. In either
    case the letter bound is part of the join condition, so what comes out is close to what the threshold keeps.
    With ``asked``, rows of ``df``, only pairs whose larger id is one of these rows come.
    """
    def prepared(some: DataFrame) -> DataFrame:
        rows = some.select(*group, F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), marks(F.col(text_col)).alias("_m"), posted(F.col(text_col), threshold).alias("_p"))
        return materialize(rows.withColumn("_head", F.substring("_t", 1, 1)), "_id")

    rows = prepared(df)
    later = rows if asked is None else prepared(asked)
    side = lambda some, s, key, *more: some.select(*group, key.alias("_key"), *more, *[F.col(c).alias(f"{c}{s}") for c in ("_id", "_t", "_m", "_head")])
    bound = jaro_winkler_reaches(F.col("_m_a"), F.col("_m_b"), threshold)
    keys, ordered = [*group, "_key"], F.col("_id_a") < F.col("_id_b")
    near = tiled_join(side(rows, "_a", F.col("_head")), side(later, "_b", F.col("_head")), keys, ordered & bound, "_id_a", "_id_b", rows_per_tile)
    n_a, n_b = F.col("_m_a.n"), F.col("_m_b.n")
    apart = (F.col("_head_a") != F.col("_head_b")) & ((n_a < n_b) | ((n_a == n_b) & ordered)) & bound
    few, many = F.col("_p.few").alias("_few"), F.col("_p.many").alias("_many")
    once = F.get(F.array_intersect("_few", "_many"), F.lit(0)) == F.col("_key")
    met = lambda a, b, on: tiled_join(side(a, "_a", F.explode("_p.few"), few), side(b, "_b", F.explode("_p.many"), many), keys, on & once, "_id_a", "_id_b", rows_per_tile).drop("_few", "_many")
    if asked is None:
        both = near.unionByName(met(rows, rows, apart))
    else:
        both = near.unionByName(met(rows, later, apart & ordered)).unionByName(met(later, rows, apart & (F.col("_id_b") < F.col("_id_a"))))
    return both.select(*group, *[F.col(f"_{c}").alias(c) for c in ("id_a", "t_a", "id_b", "t_b")]).withColumnsRenamed({"t_a": "text_a", "t_b": "text_b"})
