"""The operators over their whole tables; the columns are those of the contracts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .chat_format import format_conversations, read_back
from .imatch import edited_prints
from .language import language
from .language import train as train_languages
from .line_dedup import dedup_lines
from .mixing import mix
from .near_dup import near_duplicates
from .permutation_index import nearest
from .pieces import read_model, round_trip
from .quality import quality
from .quality import train as train_quality
from .registry import register, table
from .spelling import spelling_groups, word_counts
from .toxicity import held_out, toxicity, train
from .warc import archive_round_trip

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


@register("op1_permutation_index")
def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op3_minhash_near_dup", """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 1, 2)), lambda i: array_to_string(ws[i:i + 2], ' '))) AS shingle FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (shingle) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (
  WITH RECURSIVE r AS (SELECT a AS doc_id, a AS other FROM link UNION SELECT r.doc_id, link.b FROM r JOIN link ON link.a = r.other)
  SELECT doc_id, min(other) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(reach.root, d.doc_id) AS component_id, d.doc_id = coalesce(reach.root, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id)
""")
def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among whole documents: 3-word shingles, similarity of 85 % or more."""
    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@register("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents less lines seen before, exactly or within two edits."""
    found = dedup_lines(table(spark, sf_dir, "documents"))
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    return found.select("doc_id", F.size(F.coalesce("dropped_lines", F.array().cast("array<int>"))).alias("n_dropped"), "dropped_lines", lines.alias("n_lines"), "text")


@register("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of whole texts, with the offending spans."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(spark, F.col("text"), model).alias("t"))
    return found.select("doc_id", "held_out", "t.score", F.when(F.col("t.score") >= 0.5, 1).otherwise(0).alias("predicted"), "t.spans")


@register("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", round_trip(spark, F.col("text"), read_model(TOKENIZER)).alias("t")).select("doc_id", "t.*")


@register("op2_mix_sources")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    found = mix(table(spark, sf_dir, "documents"))
    found = found.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


@register("op9_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT *, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * g + 1, 5))::INTEGER >> s) & 31)::INTEGER, 1)), '')), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS first_id
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back."""
    found = archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op4_imatch")
def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts."""
    return edited_prints(table(spark, sf_dir, "documents"))


@register("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of whole texts."""
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality(spark, F.col("text"), model).alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


@register("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of whole texts."""
    docs = table(spark, sf_dir, "documents")
    model = train_languages(docs)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language(spark, F.col("text"), model).alias("l"))
    return found.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), "l.score")


@register("op11_chat_format")
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says the template's own marks, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(extra)))


@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers over whole texts, read against corpus-wide counts."""
    found, _ = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKENIZER)
    return found


@register("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole texts, a letter taken out of some, grouped with their more frequent spellings."""
    return spelling_groups(word_counts(table(spark, sf_dir, "documents"), every=97))
