"""The corpus pipeline: filter, clean, de-duplicate, mix and encode documents, each stage over all that the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.line_dedup import dedup_lines
from kinfold.llm.mixing import mixed
from kinfold.llm.near_dup import without_near_duplicates
from kinfold.llm.pieces import encoded, read_model
from kinfold.llm.toxicity import toxicity, train
from kinfold.session import materialize

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of one half or more go; the model learns from the labels that are not held out."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity(spark, F.col("text"), model)["score"] < 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before go, exactly or within two edits, and so do documents all of whose text went with them."""
    cleaned = dedup_lines(docs).filter("dropped_lines IS NULL OR text <> ''")
    return _recounted(cleaned.select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: runs of five words, similarity of 80 % or more."""
    return without_near_duplicates(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy the mix takes: sources weigh 5, 2, 1 and again, no document more than three times."""
    return mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy."""
    return encoded(docs, ["doc_id", "lang", "source"], read_model(TOKENIZER)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", toxic_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode_pieces),
]

#: Scores of a trained model, edit distances over whole tables and random rounding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
