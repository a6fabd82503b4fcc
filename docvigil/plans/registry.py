"""Names of all queries, each with the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docvigil.operators.fixpoint import dealt

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _counts(sql: str) -> str:
    """``count_if(x)`` as a count that DuckDB returns as a 64-bit integer."""
    while "count_if(" in sql:
        at = sql.index("count_if(")
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL, if SQL can state it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = _counts(sql)
        return fn

    return add


#: Tables whose rows are numbered in order inside a key, and that key.
NUMBERED = {"lineitem": "l_orderkey"}


def select(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of a SELECT over the given tables. Where it numbers a table's rows inside a key, the table is
    dealt out by that key beforehand, so that what a task sorts does not grow with the table."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            if name in NUMBERED and f"OVER (PARTITION BY {NUMBERED[name]} " in text:
                table = dealt(table, NUMBERED[name])
            table.createOrReplaceTempView(name)
    return spark.sql(text)
