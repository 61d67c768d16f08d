"""Entity resolution from records to golden records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocking import block_statistics, candidate_pairs, stored_profiles, with_block_key
from ..operators.cluster import attach_profile_clusters, connected_components
from ..operators.compare import DEFAULT_WEIGHTS, MATCH, REVIEW, decision_summary, may_reach, score_pairs, with_decision, with_marks
from ..operators.golden import field_provenance, golden_members, golden_records
from ..operators.pairing import ROWS_PER_TILE
from ..session import materialize


@dataclass(frozen=True)
class MatchSpec:
    """What is compared, how much it counts, and where the decisions lie; without ``passes`` all pairs of a block are."""

    weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    match: float = MATCH
    review: float = REVIEW
    tenant: str = "tenant_id"
    id_col: str = "id"
    rows_per_tile: int = ROWS_PER_TILE
    blank_as_null: bool = True
    passes: Mapping[str, Callable[[Column], Column]] | None = None

    @property
    def group(self) -> list[str]:
        return [self.tenant, "block_key"]


@dataclass(frozen=True)
class Resolution:
    """Frames of one run. ``matches`` and ``review`` hold pairs of profiles with the record pairs behind them."""

    profiles: DataFrame
    matches: DataFrame
    review: DataFrame
    clusters: DataFrame
    golden: DataFrame
    members: DataFrame
    provenance: DataFrame


def _marked(profs: DataFrame, spec: MatchSpec) -> DataFrame:
    return materialize(with_marks(profs, spec.weights), "profile_id")


def linked_pairs(profs: DataFrame, spec: MatchSpec = MatchSpec(), decided: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """Scored pairs of profiles that reach ``least``, else the review threshold, with ``decision`` and ``record_pairs``.

    ``profs`` comes from ``stored_profiles``. All pairs of a block are weighed by the letters they have in common, inside
    the join; only those that may reach the threshold are scored. Pairs in ``decided`` (tenant, ``id_a``, ``id_b``) were
    judged before and are not proposed again. Callers that want matches alone say so by ``least``: the number of pairs
    for review grows with the square of a block where little is known of its records.
    """
    least = spec.review if least is None else least
    present = [k for k in spec.weights if k in profs.columns]
    if present:
        marked = profs if all(f"_m_{k}_n" in profs.columns for k in present) else _marked(profs, spec)
        marks = [c for c in marked.columns if c.startswith("_m_")]
        marked = marked.withColumns({c: F.coalesce(c, F.lit(0)) for c in marks})  # files do not say that none is null
        pairs = candidate_pairs(marked, list(spec.weights), spec.group, spec.rows_per_tile, spec.passes, may_reach(profs.columns, spec.weights, least))
        pairs = pairs.drop(*[f"{c}{s}" for c in marks for s in ("_a", "_b")])
    else:
        pairs = candidate_pairs(profs, list(spec.weights), spec.group, spec.rows_per_tile, spec.passes)
    linked = score_pairs(pairs, spec.weights, normalized=True).filter(F.col("confidence_score") >= least)
    if decided is not None:
        linked = drop_decided(linked, decided, spec.tenant)
    return with_decision(linked, match=spec.match, review=spec.review)


def matched_pairs(profs: DataFrame, spec: MatchSpec = MatchSpec(), decided: DataFrame | None = None) -> DataFrame:
    """The pairs of ``linked_pairs`` that are matches, sought as such."""
    return linked_pairs(profs, spec, decided, max(spec.match, spec.review)).filter("decision = 'match'")


def drop_decided(pairs: DataFrame, decided: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """Pairs not judged before in their tenant, whichever way round the judgement names them."""
    a, b = F.col("id_a").cast("string"), F.col("id_b").cast("string")
    known = decided.select(tenant, F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).distinct()
    return pairs.join(known, [tenant, "id_a", "id_b"], "left_anti")


def copies(profs: DataFrame, spec: MatchSpec = MatchSpec()) -> DataFrame:
    """The record pairs inside profiles: a score of 1 where any compared value is present, else 0."""
    present = [F.col(c) for c in spec.weights if c in profs.columns]
    score = F.when(F.coalesce(*present).isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    inside = profs.filter("n_records > 1").select(
        *spec.group, F.col("profile_id"), score.alias("confidence_score"), F.expr("n_records * (n_records - 1) div 2").alias("record_pairs")
    )
    return with_decision(inside, match=spec.match, review=spec.review)


def decision_counts(records: DataFrame, profs: DataFrame, linked: DataFrame, spec: MatchSpec = MatchSpec()) -> DataFrame:
    """Record pairs per decision over all pairs of all blocks.

    Matches and reviews are summed from their rows; the non-matches are what remains of the pairs the block sizes imply.
    """
    head = ["decision", "confidence_score", "record_pairs"]
    decided = linked.select(*head).unionByName(copies(profs, spec).select(*head))
    found = materialize(decision_summary(decided.filter("decision <> 'non_match'"), "record_pairs").select("decision", "pairs"))
    total = block_statistics(records, spec.group).agg(F.sum("pairs").alias("pairs"))
    rest = total.select("pairs").union(found.select(-F.col("pairs"))).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    return found.unionByName(rest.select(F.lit("non_match").alias("decision"), "pairs"))


def assign_clusters(records: DataFrame, spec: MatchSpec = MatchSpec(), decided: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records with ``block_key`` and ``cluster_id``, profiles, linked pairs); the pairs for review are sought when read."""
    keyed = records if "block_key" in records.columns else with_block_key(records)
    attributes = list(spec.weights)
    profs = stored_profiles(keyed, attributes, spec.group, spec.id_col, spec.blank_as_null)
    marked = _marked(profs, spec)  # once for the matches and the pairs for review
    components = connected_components(matched_pairs(marked, spec, decided), scope=[spec.tenant])
    clustered = attach_profile_clusters(keyed, profs, components, attributes, spec.group, spec.id_col, spec.blank_as_null)
    return materialize(clustered), profs, linked_pairs(marked, spec, decided)


def resolve(records: DataFrame, spec: MatchSpec = MatchSpec(), decided: DataFrame | None = None,
            attributes: Sequence[str] | None = None, created_at: Column | None = None) -> Resolution:
    """Block, pair, score, decide, cluster, merge and trace."""
    clustered, profs, linked = assign_clusters(records, spec, decided)
    linked = materialize(linked)
    golden = golden_records(clustered, spec.tenant, spec.id_col, attributes, created_at)
    return Resolution(
        profiles=profs,
        matches=linked.filter("decision = 'match'"),
        review=linked.filter("decision = 'review'"),
        clusters=clustered,
        golden=golden,
        members=golden_members(clustered, spec.tenant, spec.id_col),
        provenance=field_provenance(golden, clustered, None, spec.id_col, spec.tenant, created_at),
    )
