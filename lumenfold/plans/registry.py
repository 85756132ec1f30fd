"""Where queries and the SQL that checks them are kept, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query (spark, folder) -> DataFrame under its own name, with its SQL where there is one."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(rows: list[tuple]) -> str:
    """Rows as SQL values."""
    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a table that one task gets, where each becomes a file or several rows.
ROWS = 50_000


def spread(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table dealt by its key over tasks of about ROWS rows, and over all cores at least. A scan gives a task all that a row
    group holds, up to a whole table; the count is read from the file's footer."""
    rows = read(spark, folder, name)
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS)), key)
