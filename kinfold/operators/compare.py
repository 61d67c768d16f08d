"""Pair scores and decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaro_winkler_normalized, levenshtein_similarity_normalized, normalize
from .bounds import jaro_winkler_upto, levenshtein_upto, mark_columns, marked
from .pairing import JARO_WINKLER, LEVENSHTEIN

# Default attribute weights, the attributes compared by edit distance, and the decision thresholds.
DEFAULT_WEIGHTS = {"name": 0.50, "dob": 0.20, "email": 0.30}
EDIT_DISTANCE_ATTRIBUTES = ("dob", "code", "id", "ssn", "phone")
MATCH, REVIEW = 0.90, 0.70


def similarity_method(attribute: str) -> str:
    return LEVENSHTEIN if attribute in EDIT_DISTANCE_ATTRIBUTES else JARO_WINKLER


def _similarity(attribute: str, a: Column, b: Column, normalized: bool) -> Column:
    a, b = (a, b) if normalized else (normalize(a), normalize(b))
    return levenshtein_similarity_normalized(a, b) if similarity_method(attribute) == LEVENSHTEIN else jaro_winkler_normalized(a, b, once=True)


def _side(df: DataFrame, attribute: str, suffix: str) -> Column:
    for name in (f"{attribute}{suffix}", attribute):
        if name in df.columns:
            return F.col(name)
    return F.lit(None).cast("string")


def score_pairs(pairs: DataFrame, weights: Mapping[str, float] | None = None, normalized: bool = False) -> DataFrame:
    """Add ``score_<attribute>`` per attribute and ``confidence_score``, all rounded to four places.

    The confidence is the weighted mean over the attributes present on at least one side; an attribute present on one
    side only scores 0 at full weight, one absent on both sides has no weight. Without any weight it is 0. Pairs of
    ``profiles`` hold comparison forms: ``normalized`` says so, and no value is brought into that form again for each pair.
    Each pair is scored in one place of the plan: a filter after this step stays after it, so other filters go before.
    """
    weights = dict(weights or DEFAULT_WEIGHTS)
    raw = {f"_raw_{k}": _similarity(k, _side(pairs, k, "_a"), _side(pairs, k, "_b"), normalized) for k in weights}
    scored = pairs.withColumns(raw)
    active = {k: _side(pairs, k, "_a").isNotNull() | _side(pairs, k, "_b").isNotNull() for k in weights}
    add = lambda terms: reduce(lambda a, b: a + b, terms)
    total = add([F.when(active[k], F.lit(float(w))).otherwise(0.0) for k, w in weights.items()])
    part = add([F.when(active[k], F.lit(float(w)) * F.col(f"_raw_{k}")).otherwise(0.0) for k, w in weights.items()])
    mean = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), part / F.nullif(total, F.lit(0.0))))).otherwise(0.0)
    return scored.withColumns(
        {**{f"score_{k}": F.round(f"_raw_{k}", 4) for k in weights}, "confidence_score": F.round(mean, 4)}
    ).drop(*raw)


def with_marks(profs: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Add the letter marks of each attribute that ``may_reach`` reads, in columns ``_m_<attribute>_...``."""
    return marked(profs, {f"_m_{k}": normalize(F.col(k)) for k in weights if k in profs.columns})


def may_reach(columns: Sequence[str], weights: Mapping[str, float], least: float) -> Column:
    """Whether a pair's confidence can reach ``least``, from the letters of both sides, then with exact edit distances.

    A condition on pairs of rows of ``with_marks`` that hold comparison forms, whose columns are ``columns``. It never
    excludes a pair that reaches the score, and needs native functions only. A value present on one side only scores 0, as
    in ``score_pairs``. What the attributes have above ``least`` is added up; the condition stays short enough for the JVM
    to compile it.
    """
    least -= 1e-4  # scores are rounded to four places
    letters, edits = [], []
    for k, weight in weights.items():
        if k not in columns:
            continue
        a, b = mark_columns(f"_m_{k}", "_a"), mark_columns(f"_m_{k}", "_b")
        edit = similarity_method(k) == LEVENSHTEIN
        over = lambda bound: F.lit(float(weight)) * (  # noqa: E731, B023 - called at once
            F.when(F.least(a["n"], b["n"]) > 0, bound - least).when(a["n"] != b["n"], -least).when(a["n"] == 0, 1.0 - least).otherwise(0.0))
        letters.append(over(levenshtein_upto(a, b) if edit else jaro_winkler_upto(a, b)))
        exact = 1.0 - F.levenshtein(F.col(f"{k}_a"), F.col(f"{k}_b")) / F.greatest(a["n"], b["n"])
        edits.append(over(exact) if edit else letters[-1])
    reaches = lambda terms: reduce(lambda x, y: x + y, terms) >= -1e-9
    both = any(similarity_method(k) == LEVENSHTEIN for k in weights if k in columns)
    return reaches(letters) & reaches(edits) if both else reaches(letters)


def decision(score: Column, match: float = MATCH, review: float = REVIEW) -> Column:
    return F.when(score >= F.lit(match), F.lit("match")).when(score >= F.lit(review), F.lit("review")).otherwise(F.lit("non_match"))


def with_decision(pairs: DataFrame, score_col: str = "confidence_score", match: float = MATCH, review: float = REVIEW) -> DataFrame:
    if score_col not in pairs.columns:
        raise ValueError(f"no column {score_col!r} in the scored pairs")
    return pairs.withColumn("decision", decision(F.col(score_col), match, review))


def classify_pairs(pairs: DataFrame, score_col: str = "confidence_score", match: float = MATCH, review: float = REVIEW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(match, review, non_match): three lazy filters over one ``decision`` column."""
    decided = with_decision(pairs, score_col, match, review)
    return tuple(decided.filter(F.col("decision") == d) for d in ("match", "review", "non_match"))


def decision_summary(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """Pairs and mean score per decision; ``weight`` names the number of record pairs behind a row."""
    n = F.col(weight) if weight else F.lit(1)
    return pairs.groupBy("decision").agg(
        F.sum(n).cast("bigint").alias("pairs"), F.round(F.sum(F.col("confidence_score") * n) / F.sum(n), 4).alias("avg_score")
    )
