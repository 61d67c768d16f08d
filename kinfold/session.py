"""Session settings and the shared folder every job of this library writes its intermediates to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "kinfold", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Adaptive execution splits skewed join partitions and turns a join into a broadcast only after it has seen the
    real size of the side; the library forces one only for sides of a fixed bound.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by the cluster in ``spark.checkpoint.dir``.

    Only a ``local`` master, whose executors live in the driver, may do without: it gets a temporary folder for the
    life of the application. On a cluster a missing setting is an error, because no other executor would find the files.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="kinfold-")
    return _LOCAL_FOLDERS[context.applicationId]


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, never reused, so a rerun cannot read an older run's files.

    All paths of an application lie below one folder, which goes when the driver ends.
    """
    root = f"{shared_dir(spark)}/kinfold-{spark.sparkContext.applicationId}"
    files, where = _file_system(spark, root)
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession, *paths: str) -> None:
    """Delete scratch paths no frame reads any more."""
    for path in paths:
        files, where = _file_system(spark, path)
        files.delete(where, True)


def materialize(df: DataFrame, spread_by: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and continue from the files.

    Used where several branches read one expensive frame and in the rounds of iterative jobs: the data outlives the
    executors that wrote it, the lineage does not grow, and later reads prune columns and push filters down.
    ``spread_by`` writes one part per shuffle partition: for rows that are few bytes but much work, which adaptive
    execution would otherwise pack into few tasks. ``path`` is a scratch path the caller wants to release early.
    """
    spark = df.sparkSession
    if spread_by is not None:
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), spread_by)
    path = path or scratch_path(spark, "frame")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
