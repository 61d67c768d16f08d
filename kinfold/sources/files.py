"""Files in: CSV, JSON, staged Parquet batches, and the intake check over raw files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# Limits and accepted kinds of raw files.
MAX_FILE_SIZE = 500 * 1024 * 1024
MULTIPART_THRESHOLD = 50 * 1024 * 1024
CONTENT_TYPES = {
    "csv": "text/csv",
    "json": "application/json",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Comma-separated text with a header; every column is text, empty is null.

    Short lines are padded with nulls, surplus fields dropped, values stripped of spaces and of a quote left at either
    end. A line is a record, so files split freely between tasks.
    """
    raw = spark.read.csv(
        path if isinstance(path, str) else list(path), header=True, quote='"', escape='"', mode="PERMISSIVE", multiLine=False,
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False,
    )
    bare = lambda c: F.regexp_replace(strip(F.col(f"`{c}`")), "^[\"']|[\"']$", "")
    return raw.select(*[F.nullif(bare(c), F.lit("")).alias(strip_quotes(c)) for c in raw.columns])


def strip_quotes(name: str) -> str:
    name = name.strip()
    name = name[1:] if name[:1] in "\"'" and name else name
    return name[:-1] if name[-1:] in "\"'" and name else name


def read_json(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, lines: bool = False) -> DataFrame:
    """An array of objects or one object per file; the columns are the union of all keys. Invalid text fails the read.

    One JSON document cannot be split, which the file size limit of the intake check keeps harmless; large data comes
    as one object per line (``lines=True``).
    """
    reader = spark.read.option("multiLine", not lines).option("mode", "FAILFAST")
    if schema:
        reader = reader.schema(schema)
    return reader.json(path if isinstance(path, str) else list(path))


def read_staged(spark: SparkSession, root: str, tenant_id: str | None = None, source_id: str | None = None, batch_id: str | None = None) -> DataFrame:
    """Staged batches; tenant, source and batch are partition columns, so the filters prune folders."""
    df = spark.read.parquet(root)
    for name, value in (("tenant_id", tenant_id), ("source_id", source_id), ("batch_id", batch_id)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(path, length)`` of all files below a folder; the contents are not read.

    Spark's file sources pass over files without content, so an empty file never gets in; ``check_files`` names the
    reason where the list of files comes from elsewhere (an upload log).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length")


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def check_files(files: DataFrame, tenant_id: Column, connection_id: Column) -> DataFrame:
    """Verdict per file: ``accepted``, ``reason``, ``multipart``, ``object_key`` and ``content_type``."""
    extension = file_extension(F.col("path"))
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    reason = (
        F.when(F.col("length") <= 0, F.lit("file is empty"))
        .when(F.col("length") > MAX_FILE_SIZE, F.lit("file is larger than 500 MB"))
        .when(extension == "", F.lit("file has no extension"))
        .when(~extension.isin(*CONTENT_TYPES), F.concat(F.lit("unsupported file type: ."), extension))
    )
    kind = F.lit("application/octet-stream")
    for ext, content in CONTENT_TYPES.items():
        kind = F.when(extension == ext, F.lit(content)).otherwise(kind)
    return files.withColumns(
        {
            "reason": reason,
            "multipart": F.col("length") > MULTIPART_THRESHOLD,
            "object_key": F.concat_ws("/", tenant_id, F.lit("raw"), connection_id, name),
            "content_type": kind,
        }
    ).withColumn("accepted", F.col("reason").isNull())
