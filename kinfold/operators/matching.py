"""Whole-table matching: cosine of TF-IDF vectors above a threshold, and equal identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .pairing import ROWS_PER_TILE, tiled_join
from .search import token_weights, words

#: Cosines are rounded to four digits before they meet the threshold; the bounds leave room for that and for sums in
#: another order.
_ROOM = 0.00005 + 1e-9


def _same(scope: Sequence[str], left: str, right: str) -> list[Column]:
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in scope]


def _key(scope: Sequence[str]) -> Column:
    """The columns of a scope as one text; a null is a value of its own."""
    return F.to_json(F.struct(*scope)) if scope else F.lit("")


def text_classes(df: DataFrame, id_col: str, text_col: str, scope: Sequence[str] = ()) -> DataFrame:
    """``(id, class_id, within)``: texts of a scope of the same words, whatever their order, case and marks, share the
    smallest id; ``within`` is the scope as one text.

    A text without words, or null, is a class of its own. The classes are one aggregate that combines on the map side; a
    class of any size reaches the join as one row.
    """
    rows = df.select(F.col(id_col).alias("id"), _key(scope).alias("within"), F.array_join(F.array_sort(words(F.col(text_col))), " ").alias("bag"))
    rows = rows.withColumn("bag", F.nullif("bag", F.lit("")))
    first = rows.filter("bag IS NOT NULL").groupBy(F.col("within").alias("_in"), F.col("bag").alias("_bag")).agg(F.min("id").alias("class_id"))
    found = rows.join(first, (F.col("within") == F.col("_in")) & (F.col("bag") == F.col("_bag")), "left")
    return found.select("id", F.coalesce("class_id", "id").alias("class_id"), "within")


def posted_prefixes(weights: DataFrame, threshold: float) -> DataFrame:
    """``(id, token, weight, rest)``: the words of each vector that have to be looked up, rarest word first.

    The words of a vector are ordered by how many vectors hold them. From the most frequent on, words are left out while
    what they could add to any cosine stays below the threshold: at most the sum of each weight times the largest weight
    the word has anywhere, and at most the length of the part left out. Two vectors at or above the threshold have their
    rarest common word among the posted words of both: were it left out of one of them, all common words would be, and they
    add up to less than the threshold. ``rest`` is the length of the vector behind the word.
    """
    words_of = weights.groupBy("token").agg(F.count("*").alias("_df"), F.max("weight").alias("_most"))
    behind = Window.partitionBy("id").orderBy(F.desc("_df"), F.desc("token")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = weights.join(words_of, "token").select("id", "token", "weight", "_df", "_most")
    square = F.sum(F.col("weight") * F.col("weight")).over(behind)
    ranked = ranked.withColumn("_reach", F.sum(F.col("weight") * F.col("_most")).over(behind)).withColumn("_upto", square)
    rest = F.sqrt(F.greatest(F.lit(0.0), F.col("_upto") - F.col("weight") * F.col("weight")))
    posted = ranked.filter(F.least("_reach", F.sqrt("_upto")) >= threshold)
    return posted.select("id", "token", "weight", rest.alias("rest"))


def cosine_join(df: DataFrame, id_col: str, text_col: str, threshold: float, scope: Sequence[str] = (), rows_per_tile: int = ROWS_PER_TILE) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: all texts whose TF-IDF cosine, rounded to four digits, is at least ``threshold`` (above 0).

    ``members``: ``id, class_id, within`` for every row, see ``text_classes``; ids have to be unique. ``pairs``: ``id_a,
    id_b, cosine`` between classes of one scope, ``id_a < id_b``. Frequencies are those of the whole table, each class once,
    so copies do not make a word common.
    Texts that are null or have no words are in no pair. Other columns are ignored; an empty table gives empty frames.

    Vectors meet under their posted words (``posted_prefixes``) in tiles of ``rows_per_tile`` a side, so a word that many
    vectors post is spread over tasks. A pair goes on only where the product at the word plus the product of the lengths
    behind it reaches the threshold, which holds at the rarest common word of every pair wanted. What goes on is scored
    by its whole vectors. No pair is lost.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    least = threshold - _ROOM
    members = materialize(text_classes(df, id_col, text_col, scope))
    firsts = members.filter("id = class_id").select("id", "within")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(firsts, "id")
    weights = materialize(token_weights(texts, "id", "text"))
    posted = materialize(posted_prefixes(weights, least).join(firsts, "id"))
    left = posted.select("within", "token", F.col("id").alias("id_a"), F.col("weight").alias("_wa"), F.col("rest").alias("_ra"))
    right = posted.select("within", "token", F.col("id").alias("id_b"), F.col("weight").alias("_wb"), F.col("rest").alias("_rb"))
    on = (F.col("id_a") < F.col("id_b")) & (F.col("_wa") * F.col("_wb") + F.col("_ra") * F.col("_rb") >= least)
    met = tiled_join(left, right, ["within", "token"], on, "id_a", "id_b", rows_per_tile).select("id_a", "id_b").distinct()
    return score_pairs(met, weights).filter(F.col("cosine") >= threshold), members


def score_pairs(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Add ``cosine`` of the whole vectors, rounded to four digits, to distinct pairs that share a word."""
    side = lambda s: weights.select(F.col("id").alias(f"id_{s}"), "token", F.col("weight").alias(f"_w{s}"))
    both = pairs.join(side("a"), "id_a").join(side("b"), ["id_b", "token"])
    return both.groupBy("id_a", "id_b").agg(F.round(F.sum(F.col("_wa") * F.col("_wb")), 4).alias("cosine"))


def link_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, class_id, n_links)``: every row with its class and the number of other classes linked with that."""
    ends = pairs.select(F.col("id_a").alias("class_id")).unionByName(pairs.select(F.col("id_b").alias("class_id")))
    counts = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(counts, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def identifier_links(df: DataFrame, identifiers: Sequence[str], id_col: str = "id", scope: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """``(*scope, identifier, id_a, id_b, holders)``: rows that carry the same value of an identifying column.

    Each row is linked with the smallest id that holds the value, so a value of ``holders`` rows makes ``holders - 1``
    links, and components over the links hold all of them. Values are compared as text, trimmed, any case; null and blank
    ones link nothing, and a value of one column is never compared with another's. Rows that repeat an id are one holder.
    """
    values = [F.struct(F.lit(c).alias("identifier"), F.lower(F.trim(F.col(c).cast("string"))).alias("value")) for c in identifiers]
    held = df.select(*scope, F.col(id_col).alias("id_b"), F.explode(F.array(*values)).alias("_v")).select(*scope, "id_b", "_v.identifier", "_v.value")
    held = held.filter("value <> ''").distinct()
    keys = [*scope, "identifier", "value"]
    first = held.groupBy(*keys).agg(F.min("id_b").alias("id_a"), F.count("*").alias("holders")).filter("holders > 1")
    on = [*_same(scope, "h", "f"), F.col("h.identifier") == F.col("f.identifier"), F.col("h.value") == F.col("f.value"), F.col("h.id_b") != F.col("f.id_a")]
    shown = [*(F.col(f"h.{c}") for c in scope), F.col("h.identifier"), F.col("id_a"), F.col("id_b"), F.col("holders")]
    return held.alias("h").join(first.alias("f"), on).select(*shown)
