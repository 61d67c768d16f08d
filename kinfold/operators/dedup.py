"""Exact and fuzzy removal of duplicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, jaro_winkler_raw, metaphone, normalize
from ..session import materialize
from .bounds import jaro_winkler_candidates, jaro_winkler_reaches, marks
from .pairing import ROWS_PER_TILE, pass_pairs, tiled_join


def dedup_exact(df: DataFrame, keys: Sequence[str], order_by: str | Sequence[str] | Column = "id") -> DataFrame:
    """Keep the first row per key.

    ``row_number = 1`` is planned with a group limit before the shuffle: every task sends at most one row per key, so
    a key that fills a third of the table costs one row per task.
    """
    order = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def name_passes(text: Column) -> list[Column]:
    """Passes for callers that give up pairs for speed: texts that sound alike, or share first letter and last word."""
    plain = normalize(text)
    return [metaphone(plain), F.concat(F.substring(plain, 1, 1), F.lit(" "), F.substring_index(plain, " ", -1))]


#: Letters at the start that texts share with the earliest texts they are held against first, and how many of these.
_EARLIEST = ((4, 8), (1, 64))


def _similar_to_earliest(firsts: DataFrame, block: Sequence[str], left: DataFrame, letters: int, n: int, threshold: float, rows_per_tile: int) -> DataFrame:
    """``_first`` of the rows of ``left`` that are similar to an earlier one of the ``n`` earliest with the same first letters.

    The few earliest of a start are found by a group limit, so the join makes at most ``n`` pairs a row.
    """
    keys, start = [*block, "_start"], F.substring("_text", 1, letters).alias("_start")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))
    side = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{c}{s}") for c in ("_first", "_text", "_m")])
    early = side(firsts.select("*", start).withColumn("_rank", rank).filter(F.col("_rank") <= n), "_a")
    bound = jaro_winkler_reaches(F.col("_m_a"), F.col("_m_b"), threshold)
    pairs = tiled_join(side(left.select("*", start), "_b"), early, keys, (F.col("_first_a") < F.col("_first_b")) & bound, "_first_b", "_first_a", rows_per_tile)
    return pairs.filter(jaro_winkler_raw(F.col("_text_a"), F.col("_text_b")) >= F.lit(threshold)).select(F.col("_first_b").alias("_first")).distinct()


def _unlike_earlier(firsts: DataFrame, block: Sequence[str], threshold: float, rows_per_tile: int) -> DataFrame:
    """The rows of ``firsts`` that no earlier similar text of their block removes.

    One earlier similar text is enough. So texts are held against the few earliest with the same first letters, and only
    what is left after that against all earlier ones of their block.
    """
    firsts = materialize(firsts.withColumn("_m", marks(F.col("_text"))), "_first")
    left = firsts
    for letters, n in _EARLIEST:
        left = materialize(left.join(_similar_to_earliest(firsts, block, left, letters, n, threshold, rows_per_tile), "_first", "left_anti"))
    last = left.groupBy(*block).agg(F.max("_first").alias("_last"))
    before = firsts.join(last, list(block)).filter("_first <= _last").select(*block, "_first", "_text")
    pairs = jaro_winkler_candidates(before, list(block), "_first", "_text", threshold, rows_per_tile, left.select(*block, "_first", "_text"))
    similar = pairs.filter(jaro_winkler_raw(F.col("text_a"), F.col("text_b")) >= F.lit(threshold))
    return left.join(similar.select(F.greatest("id_a", "id_b").alias("_first")).distinct(), "_first", "left_anti")


def fuzzy_survivors(df: DataFrame, id_col: str = "id", block: Sequence[str] = ("country",), text_col: str = "name", threshold: float = 0.85,
                    passes: Callable[[Column], list[Column]] | None = None, rows_per_tile: int = ROWS_PER_TILE) -> DataFrame:
    """First id of each (block, text) that no earlier similar text in the block removes.

    A row goes when any earlier row of its block is similar, even one that goes itself. With the smallest id of every
    distinct text at hand this needs no pairing of rows: a row stays exactly when it is the first of its text and no
    similar text has an earlier first row. No row is kept that an earlier similar text removes, and only texts that no
    early text with the same first letters removes are compared with all; with ``passes``, only those that share one.
    """
    firsts = (
        df.filter(~is_blank(F.col(text_col)))
        .groupBy(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in block], F.col(text_col).alias("_text"))
        .agg(F.min(id_col).alias("_first"))
    )
    if passes is None:
        return _unlike_earlier(firsts, block, threshold, rows_per_tile).select(F.col("_first").alias(id_col))
    firsts = materialize(firsts, "_first")
    pairs = pass_pairs(firsts, list(block), "_first", passes(F.col("_text")), ["_text"], rows_per_tile).withColumnsRenamed(
        {"_first_a": "id_a", "_first_b": "id_b", "_text_a": "text_a", "_text_b": "text_b"})
    similar = pairs.filter(jaro_winkler_raw(F.col("text_a"), F.col("text_b")) >= F.lit(threshold))
    later = similar.select(F.greatest("id_a", "id_b").alias("_first")).distinct()
    return firsts.join(later, "_first", "left_anti").select(F.col("_first").alias(id_col))


def dedup_fuzzy(df: DataFrame, id_col: str = "id", block: Sequence[str] = ("country",), text_col: str = "name", threshold: float = 0.85,
                passes: Callable[[Column], list[Column]] | None = None, rows_per_tile: int = ROWS_PER_TILE) -> DataFrame:
    """Drop every row whose text is similar to that of an earlier row of its block; blank texts match nothing."""
    keep = fuzzy_survivors(df, id_col, block, text_col, threshold, passes, rows_per_tile).withColumn("_kept", F.lit(True))
    return df.join(keep, id_col, "left").filter(is_blank(F.col(text_col)) | F.col("_kept")).drop("_kept")


def dedup_report(raw: DataFrame, exact: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """One row: rows in, after the exact and the fuzzy step, and what each removed."""
    size = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
    steps = size(raw, "rows_in").unionByName(size(exact, "after_exact")).unionByName(size(fuzzy, "after_fuzzy"))
    at = lambda name: F.sum(F.when(F.col("step") == name, F.col("n"))).alias(name)
    return steps.agg(at("rows_in"), at("after_exact"), at("after_fuzzy")).withColumns(
        {"removed_exact": F.expr("rows_in - after_exact"), "removed_fuzzy": F.expr("after_exact - after_fuzzy")}
    )
