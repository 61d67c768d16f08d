"""Schema mapping: source columns to entity properties."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import parse_date
from ..functions.text import jaro_winkler, normalize, strip
from ..session import materialize
from .bounds import jaro_winkler_candidates

# Types a property can have and the Spark type a cast to it gives.
PROPERTY_TYPES = {
    "string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "timestamp": "timestamp", "json": "string",
}


def transformation(kind: str | None, c: Column) -> Column:
    """One of NONE, UPPERCASE, LOWERCASE, TRIM, DATE_PARSE; absent means NONE."""
    kind = (kind or "NONE").upper()
    options = {
        "NONE": lambda: c, "UPPERCASE": lambda: F.upper(c), "LOWERCASE": lambda: F.lower(c),
        "TRIM": lambda: strip(c), "DATE_PARSE": lambda: parse_date(c),
    }
    if kind not in options:
        raise ValueError(f"unknown transformation {kind!r}")
    return options[kind]()


def apply_mappings(df: DataFrame, mappings: Iterable[Mapping[str, object]], keep: Sequence[str] = ()) -> dict[str, DataFrame]:
    """One lazy projection per target entity type, from the active mapping rows whose source column exists.

    The mapping table is configuration of a few rows per connector; it becomes the select list.
    """
    select: dict[str, dict[str, Column]] = {}
    for m in mappings:
        if m.get("is_active", True) and m["source_column"] in df.columns:
            value = transformation(m.get("transformation"), F.col(m["source_column"]))
            select.setdefault(str(m["target_entity_type"]), {})[str(m["target_property"])] = value
    return {
        entity: df.select(*keep, *[c.alias(name) for name, c in columns.items()]) for entity, columns in select.items()
    }


def resolve_mapping_rules(rules: DataFrame, order_by: str = "created_at") -> DataFrame:
    """One source maps to one property and back: a later rule replaces the earlier ones on either side.

    A rule survives exactly when no later rule has its source column or its property; ``order_by`` orders all rules.
    """
    latest = lambda side: rules.groupBy(side).agg(F.max(order_by).alias(order_by))
    return rules.join(latest("source_column"), ["source_column", order_by], "left_semi").join(
        latest("target_property"), ["target_property", order_by], "left_semi"
    )


def mapper_rule(kind: str, c: Column, property_type: str = "string") -> Column:
    """``direct`` keeps the value, ``cast`` reads it as the property's type (null if unreadable), ``normalize`` trims and lowers."""
    if kind == "direct":
        return c
    if kind == "cast":
        return c.try_cast(PROPERTY_TYPES[property_type])
    if kind == "normalize":
        return normalize(c)
    raise ValueError(f"unknown mapper rule {kind!r}")


def mapping_coverage(source_columns: DataFrame, properties: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row: mapped and total source columns, and how many required properties no mapping fills."""
    mapped = source_columns.join(mappings.select("source_column").distinct(), "source_column", "left_semi")
    unfilled = properties.filter("required").join(
        mappings.select(F.col("target_property").alias("property")).distinct(), "property", "left_anti"
    )
    size = lambda df: df.agg(F.count("*")).scalar()
    return source_columns.agg(F.count("*").alias("total_columns")).withColumns(
        {"mapped_columns": size(mapped), "required_unfilled": size(unfilled)}
    )


def unfilled_properties(properties: DataFrame, mappings: DataFrame) -> DataFrame:
    """Required properties without a mapping."""
    filled = mappings.select(F.col("target_property").alias("property")).distinct()
    return properties.filter("required").join(filled, "property", "left_anti")


def include_columns(df: DataFrame, active: Mapping[str, bool]) -> DataFrame:
    """Keep the columns switched on; a column without a switch is kept."""
    return df.select(*[c for c in df.columns if active.get(c, True)])


def _scored_names(source_columns: DataFrame, properties: DataFrame, min_score: float) -> DataFrame:
    """``(source_column, property, score)`` of all pairs that reach ``min_score``, found by the letters names share."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    left = materialize(source_columns.select("source_column", plain(F.col("source_column")).alias("name")).filter("name <> ''"))
    right = materialize(properties.select("property", plain(F.col("property")).alias("name")).filter("name <> ''"))
    names = materialize(left.select("name").unionByName(right.select("name")).distinct())
    pairs = jaro_winkler_candidates(names, [], "name", "name", min_score - 5e-5).select("id_a", "id_b").distinct()
    score = F.round(jaro_winkler(F.col("name_a"), F.col("name_b")), 4)
    both = pairs.toDF("name_a", "name_b").unionByName(pairs.toDF("name_b", "name_a")).unionByName(names.select(F.col("name").alias("name_a"), F.col("name").alias("name_b")))
    met = both.join(left.select("name").distinct().toDF("name_a"), "name_a", "left_semi").join(right.select("name").distinct().toDF("name_b"), "name_b", "left_semi")
    scored = met.withColumn("score", score).filter(F.col("score") >= min_score)
    return scored.join(left.withColumnRenamed("name", "name_a"), "name_a").join(right.withColumnRenamed("name", "name_b"), "name_b").select("source_column", "property", "score")


def suggest_mappings(source_columns: DataFrame, properties: DataFrame, min_score: float = 0.7) -> DataFrame:
    """Best property for every source column by Jaro-Winkler of the names (ties by property name), where one reaches ``min_score``.

    Names are compared without case and signs; a name without letters and digits has no suggestion. Several columns may
    get the same property: see ``assign_mappings``.
    """
    best = F.min(F.struct((-F.col("score")).alias("low"), "property")).alias("_b")
    return _scored_names(source_columns, properties, min_score).groupBy("source_column").agg(best).select(
        "source_column", F.col("_b.property").alias("property"), (-F.col("_b.low")).alias("score")
    )


def assign_mappings(source_columns: DataFrame, properties: DataFrame, min_score: float = 0.7) -> DataFrame:
    """``(source_column, property, score)``: each column and each property at most once, the best pairs first.

    Equal to taking pairs by falling score, then column and property name, and skipping what is taken: in a round every
    pair that is the best one left for its column and for its property is taken, which a pair taken earlier cannot
    change. Rounds go on until no pair is left; repeated rows count once.
    """
    left = materialize(_scored_names(source_columns, properties, min_score).distinct())
    taken = left.limit(0)
    order = F.struct((-F.col("score")).alias("low"), "source_column", "property")
    while not left.isEmpty():
        picks = [left.groupBy(side).agg(F.min(order).alias("_b")).select("_b.*") for side in ("source_column", "property")]
        both = materialize(picks[0].join(picks[1], ["low", "source_column", "property"], "left_semi").select("source_column", "property", (-F.col("low")).alias("score")))
        taken = taken.unionByName(both)
        left = materialize(left.join(both, "source_column", "left_anti").join(both, "property", "left_anti"))
    return taken
