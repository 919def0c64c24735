"""Comparing a Spark result with the result of SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def difference(spark_df, connection, sql: str) -> str | None:
    """None when equal, else a short description."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = bag(names, cursor.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns differ: {sorted(set(names) ^ set(spark_df.columns))}"
    actual = bag(spark_df.columns, (tuple(r) for r in spark_df.collect()))
    if actual == expected:
        return None
    only_spark, only_duck = actual - expected, expected - actual
    return (
        f"rows {sum(actual.values())} vs {sum(expected.values())}; only in Spark {sum(only_spark.values())}, "
        f"only in DuckDB {sum(only_duck.values())}; e.g. {next(iter(only_spark), None)} / {next(iter(only_duck), None)}"
    )
