"""Block keys, candidate pairs and the reduction they bring."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparison_value, is_blank, metaphone, normalize, strip, title_case
from ..session import materialize
from .pairing import ROWS_PER_TILE, pass_pairs


def block_key(name: Column, country: Column, entity_type: Column) -> Column:
    """``{phonetic name or EMPTY}_{COUNTRY or GLOBAL}_{Entity Type or DEFAULT}``."""
    code = metaphone(F.coalesce(name, F.lit("")))
    return F.concat_ws(
        "_",
        F.when(code == "", F.lit("EMPTY")).otherwise(code),
        F.when(is_blank(country), F.lit("GLOBAL")).otherwise(F.upper(strip(country))),
        F.when(is_blank(entity_type), F.lit("DEFAULT")).otherwise(title_case(strip(entity_type))),
    )


def with_block_key(df: DataFrame, name: str = "name", country: str = "country", entity_type: str = "entity_type", output: str = "block_key") -> DataFrame:
    """Add the block key; an absent column counts as null in every row."""
    column = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.withColumn(output, block_key(column(name), column(country), column(entity_type)))


def with_prefix_block_key(df: DataFrame, name: str = "name", country: str = "country", output: str = "block_key", letters: int = 3) -> DataFrame:
    """Alternative key: the first letters of the name and the country."""
    start = F.substring(F.coalesce(normalize(F.col(name)), F.lit("")), 1, letters)
    return df.withColumn(output, F.concat_ws("_", start, F.coalesce(F.upper(strip(F.col(country))), F.lit(""))))


def profiles(df: DataFrame, attributes: Sequence[str], group: Sequence[str] = ("tenant_id", "block_key"), id_col: str = "id", blank_as_null: bool = True) -> DataFrame:
    """One row per block and distinct comparison values: ``profile_id`` (the smallest record id) and ``n_records``.

    Records with the same comparison values behave the same against every other record, so everything after this step
    works on profiles and carries counts. The aggregate combines on the map side: a group of copies that fills a third
    of the table leaves each task as one row. Blanks count as missing unless ``blank_as_null`` is off, in which case two
    empty texts are alike.
    """
    values = [comparison_value(F.col(c), blank_as_null).alias(c) for c in attributes if c in df.columns]
    return df.groupBy(*group, *values).agg(F.min(F.col(id_col).cast("string")).alias("profile_id"), F.count("*").alias("n_records"))


def stored_profiles(df: DataFrame, attributes: Sequence[str], group: Sequence[str] = ("tenant_id", "block_key"), id_col: str = "id", blank_as_null: bool = True) -> DataFrame:
    """``profiles`` written once to the shared folder, spread evenly for the pairing that follows."""
    return materialize(profiles(df, attributes, group, id_col, blank_as_null), "profile_id")


def _born(c: Column) -> Column:
    return F.substring(c, 1, 9)


def _mail(c: Column) -> Column:
    return F.substring(F.substring_index(c, "@", 1), 1, 8)


# Passes for callers that give up pairs for speed: a birth date but for its last digit, the start of a mail name, the
# whole name. Pairs that share none of them are not compared, whatever their score would be.
PASSES = {"dob": _born, "email": _mail, "name": lambda c: c}


def candidate_pairs(
    profs: DataFrame, attributes: Sequence[str], group: Sequence[str] = ("tenant_id", "block_key"), rows_per_tile: int = ROWS_PER_TILE,
    passes: Mapping[str, Callable[[Column], Column]] | None = None, where: Column | None = None,
) -> DataFrame:
    """All pairs of profiles of a block, ``id_a < id_b``, compared columns as ``_a`` / ``_b``.

    ``n_records_a * n_records_b`` record pairs stand behind a row. A block may hold any number of profiles; a large one
    is spread over tiles. With ``passes`` only profiles that share one are compared, and all other pairs of the block
    count as non-matches (``block_statistics``) unseen; ``where`` is a condition on a pair, checked inside the join.
    ``profs`` is read several times: give a frame from ``stored_profiles``.
    """
    present = [c for c in attributes if c in profs.columns]
    keys = [F.lit("all")] if passes is None else [key(F.col(c)) for c, key in passes.items() if c in present]
    carry = [c for c in profs.columns if c not in (*group, "profile_id")]
    pairs = pass_pairs(profs, group, "profile_id", keys, carry, rows_per_tile, where).withColumnsRenamed({"profile_id_a": "id_a", "profile_id_b": "id_b"})
    return pairs.withColumn("record_pairs", F.col("n_records_a") * F.col("n_records_b"))


def block_statistics(df: DataFrame, group: Sequence[str] = ("tenant_id", "block_key")) -> DataFrame:
    """Records and record pairs per block, from counts alone."""
    return df.groupBy(*group).agg(F.count("*").alias("records")).withColumn("pairs", F.expr("records * (records - 1) div 2"))


def reduction_ratio(records: Column, pairs: Column) -> Column:
    """``1 - pairs / (n (n - 1) / 2)`` in [0, 1]; 1 for fewer than two records."""
    possible = (records * (records - 1) / 2).cast("double")
    return F.when(records < 2, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - pairs.cast("double") / F.nullif(possible, F.lit(0.0))))
    )


def blocking_reduction(df: DataFrame, group: Sequence[str] = ("tenant_id", "block_key"), within: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Per tenant: records, candidate pairs and reduction ratio. No pair is built."""
    totals = block_statistics(df, group).groupBy(*within).agg(F.sum("records").alias("records"), F.sum("pairs").alias("pairs"))
    return totals.withColumn("reduction_ratio", reduction_ratio(F.col("records"), F.col("pairs")))
