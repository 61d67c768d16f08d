"""Relational sources through Spark's JDBC reader."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per fetch, system schemas left out of discovery, and URL forms per connector kind.
FETCH_SIZE = 1000
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")
URLS = {
    "POSTGRESQL": "jdbc:postgresql://{host}:{port}/{database}",
    "MYSQL": "jdbc:mysql://{host}:{port}/{database}",
    "MSSQL": "jdbc:sqlserver://{host}:{port};databaseName={database}",
}


def jdbc_url(kind: str, host: str, port: int, database: str) -> str:
    return URLS[kind.upper()].format(host=host, port=port, database=database)


def extract_options(table: str, partition_column: str | None = None, lower: object = None, upper: object = None, partitions: int | None = None) -> dict[str, str]:
    """Reader options of a table extract: cursor fetches of 1000 rows and, with a column and its bounds, parallel ranges.

    The ranges only divide the work: rows outside the bounds are read by the first and last task, none is lost.
    """
    options = {"dbtable": table, "fetchsize": str(FETCH_SIZE)}
    if partition_column is not None:
        if lower is None or upper is None or not partitions:
            raise ValueError("a partition column needs lower and upper bounds and a number of partitions")
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions),
        }
    return options


def _load(spark: SparkSession, url: str, connection: Mapping[str, str], options: Mapping[str, str]) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).options(**connection).options(**options).load()


def column_bounds(spark: SparkSession, url: str, connection: Mapping[str, str], table: str, column: str) -> tuple[object, object]:
    """Smallest and largest value of a column, computed by the database."""
    row = _load(spark, url, connection, {"query": f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}"}).first()
    return row[0], row[1]


def extract_table(spark: SparkSession, url: str, connection: Mapping[str, str], schema: str, table: str,
                  partition_column: str | None = None, partitions: int | None = None) -> DataFrame:
    """All rows of a table. With a partition column (a number, date or timestamp) the read runs in parallel ranges."""
    name, bounds = f"{schema}.{table}", (None, None)
    if partition_column is not None:
        bounds = column_bounds(spark, url, connection, name, partition_column)
        if bounds[0] is None:
            partition_column = None
    return _load(spark, url, connection, extract_options(name, partition_column, *bounds, partitions=partitions))


def discover_tables(tables: DataFrame) -> DataFrame:
    """``(table_schema, table_name)`` in order: base tables outside the system schemas, from ``information_schema.tables``."""
    user = tables.filter((F.col("table_type") == "BASE TABLE") & ~F.col("table_schema").isin(*SYSTEM_SCHEMAS))
    return user.select("table_schema", "table_name").orderBy("table_schema", "table_name")


def discover_columns(columns: DataFrame, schema: str, table: str) -> DataFrame:
    """Column names of a table in order, from ``information_schema.columns``."""
    own = columns.filter((F.col("table_schema") == schema) & (F.col("table_name") == table))
    return own.orderBy("ordinal_position").select("column_name")


def read_catalog(spark: SparkSession, url: str, connection: Mapping[str, str], view: str) -> DataFrame:
    """``information_schema.<view>`` of a database."""
    return _load(spark, url, connection, {"query": f"SELECT * FROM information_schema.{view}"})


def search_tables(tables: DataFrame, term: str) -> DataFrame:
    """Tables whose name or schema contains the term, any case; a schema without such a table does not appear."""
    if not term.strip():
        return tables
    wanted = F.lit(term.lower())
    return tables.filter(F.contains(F.lower("table_name"), wanted) | F.contains(F.lower("table_schema"), wanted))
