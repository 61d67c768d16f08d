"""Batch intake: clean, de-duplicate, validate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import clean
from ..operators.dedup import dedup_exact, dedup_fuzzy
from ..operators.quality import split_valid
from ..session import materialize


@dataclass(frozen=True)
class Intake:
    cleaned: DataFrame
    exact: DataFrame
    fuzzy: DataFrame
    valid: DataFrame
    invalid: DataFrame


def intake(raw: DataFrame, scope: Sequence[str] = (), id_col: str = "id", store: bool = False) -> Intake:
    """Clean, drop repeated e-mails, drop similar names per country, validate.

    ``scope`` (tenant, source) keeps batches apart that are processed in one job: duplicates are sought inside a scope
    only, and ids need to be unique inside a scope only. ``store`` writes the de-duplicated rows to the shared folder
    once, for callers that go on to write both the valid and the invalid ones.
    """
    cleaned = clean(raw)
    exact = dedup_exact(cleaned, [*scope, "email"], id_col) if "email" in cleaned.columns else cleaned
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in (*scope, id_col)])
    keyed = exact.withColumn("_key", key) if scope else exact
    fuzzy = dedup_fuzzy(keyed, "_key" if scope else id_col, [*scope, "country"]).drop("_key")
    fuzzy = materialize(fuzzy) if store else fuzzy
    valid, invalid = split_valid(fuzzy)
    return Intake(cleaned, exact, fuzzy, valid, invalid)
