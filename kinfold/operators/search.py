"""Entity search on the entities table, token similarity of names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, term: str, columns: Sequence[str], entity_type: str | None = None, source: str | None = None,
           date_from: str | None = None, date_to: str | None = None, date_column: str = "created_at") -> DataFrame:
    """Rows whose columns contain the term, any case, narrowed by type, source and date range (``date_to`` exclusive).

    ``highlights`` maps each matching column to its text with the term marked by ``<em>``.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    hits = {c: F.contains(F.lower(v), F.lit(term.lower())) for c, v in text.items()}
    found = df.filter(reduce(lambda a, b: a | b, hits.values()))
    found = filter_results(found, entity_type, source, date_from, date_to, date_column)
    marked = [
        F.when(hits[c], F.struct(F.lit(c).alias("key"), F.regexp_replace(v, "(?i)(" + re.escape(term) + ")", "<em>$1</em>").alias("value")))
        for c, v in text.items()
    ]
    return found.withColumn("highlights", F.map_from_entries(F.array_compact(F.array(*marked))))


def filter_results(df: DataFrame, entity_type: str | None = None, source: str | None = None, date_from: str | None = None,
                   date_to: str | None = None, date_column: str = "created_at") -> DataFrame:
    """Type, source and date-range predicates; all of them reach the scan."""
    if entity_type is not None:
        df = df.filter(F.col("entity_type") == entity_type)
    if source is not None:
        df = df.filter(F.col("source_id") == source)
    when = df.schema[date_column].dataType.simpleString() if date_column in df.columns else "timestamp"
    if date_from is not None:
        df = df.filter(F.col(date_column) >= F.lit(date_from).cast(when))
    if date_to is not None:
        df = df.filter(F.col(date_column) < F.lit(date_to).cast(when))
    return df


def words(text: Column) -> Column:
    """The runs of letters and digits of a text in lower case, in order; null for null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_weights(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, token, weight)``: TF-IDF of the words of a text, each vector of length 1."""
    counts = df.select(F.col(id_col).alias("id"), F.explode(words(F.col(text_col))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    total = df.agg(F.count("*")).scalar()
    idf = counts.groupBy("token").agg(F.count("*").alias("_df")).withColumn("_n", total).select(
        "token", (F.log((F.col("_n") + 1.0) / (F.col("_df") + 1.0)) + 1.0).alias("_idf")
    )
    raw = counts.join(idf, "token").withColumn("_w", F.col("tf") * F.col("_idf"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norm, "id").select("id", "token", (F.col("_w") / F.col("_norm")).alias("weight"))


def with_vectors(df: DataFrame, weights: DataFrame, id_col: str = "id", output: str = "vector") -> DataFrame:
    """Add the words of each row and their ``token_weights`` as a map; null for a text without words."""
    vectors = weights.groupBy(F.col("id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias(output))
    return df.join(vectors, F.col(id_col) == F.col("_id"), "left").drop("_id")


def tfidf_cosine(pairs: DataFrame, weights: DataFrame | None = None, id_a: str = "id_a", id_b: str = "id_b") -> DataFrame:
    """Add ``tfidf_cosine`` to given pairs; pairs without a common word score 0.

    Only the given pairs are scored, so a word that occurs everywhere costs a step per pair and not a row per pair of
    texts that contain it. Pairs of rows of ``with_vectors`` bring ``vector_a`` and ``vector_b`` along, which are dropped:
    no pair is sent anywhere. To other pairs the vectors of both sides are joined.
    """
    if weights is not None:
        pairs = with_vectors(with_vectors(pairs, weights, id_a, "vector_a"), weights, id_b, "vector_b")
    a, b = F.col("vector_a"), F.col("vector_b")
    dot = F.aggregate(F.map_entries(a), F.lit(0.0), lambda total, e: total + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
    return pairs.withColumn("tfidf_cosine", F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.round(dot, 4))).drop("vector_a", "vector_b")
