"""Deterministic views of the given tables in the shapes that the operators read. Each is one SELECT
that Spark and DuckDB both accept; lines of documents differ by dialect only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docvigil.plans.registry import select

_LINES = {
    "spark": r"SELECT d.doc_id, t.idx, t.text FROM documents d LATERAL VIEW posexplode(split(d.text, '\n')) t AS idx, text",
    "duckdb": "SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS idx, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
}

#: Lines of documents as blocks of pages of 50 lines.
_BLOCKS = """
    SELECT doc_id, idx, CONCAT(CAST(doc_id AS STRING), '-', CAST(idx AS STRING)) AS block_id,
           CAST(floor(idx / 50) AS INT) + 1 AS page, CAST(72 AS DOUBLE) AS x, CAST(72 + 14 * (idx % 50) AS DOUBLE) AS y,
           CAST(least(5 * length(text), 468) AS DOUBLE) AS w, CAST(12 AS DOUBLE) AS h,
           CASE WHEN idx = 0 AND length(text) < 80 THEN 'heading' WHEN text LIKE '%|%' THEN 'table' ELSE 'paragraph' END AS type,
           ((doc_id * 7 + idx * 13) % 41 + 60) / CAST(100 AS DOUBLE) AS confidence, text
    FROM lines
"""

#: Cells that were expected, and what became of them.
_CELLS = """
    SELECT case_id, CONCAT('t', CAST(l_linenumber % 3 AS STRING)) AS table_id, CAST(cell AS STRING) AS cell_id,
           CONCAT('value ', CAST(l_partkey AS STRING)) AS text, l_linenumber AS source_page, CAST(l_suppkey AS DOUBLE) AS source_x,
           l_partkey, l_suppkey, l_discount, l_returnflag,
           l_partkey % 17 = 0 AS lost, l_partkey % 11 = 0 AS changed, l_partkey % 13 = 0 AS unsourced,
           l_discount >= 0.05 AS requires_review, l_suppkey % 5 = 0 AS auto_confirmed
    FROM (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS cell,
                 l_linenumber, l_partkey, l_suppkey, l_discount, l_returnflag FROM lineitem) s
"""

_ACTUAL = """
    SELECT case_id, table_id, cell_id, CASE WHEN changed THEN CONCAT(text, '?') ELSE CONCAT('  ', text, ' ') END AS text,
           CASE WHEN unsourced THEN NULL ELSE source_page END AS source_page, CASE WHEN unsourced THEN NULL ELSE source_x END AS source_x,
           auto_confirmed, requires_review, l_partkey, l_suppkey FROM cells WHERE NOT lost
"""

#: Events of jobs in order, one job a user.
_LOG = """
    SELECT event_id, user_id AS job_id, user_id % 7 AS actor, event_type AS action, value, props, ts,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS true_seq,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + CASE WHEN event_id % 997 = 0 THEN 1 ELSE 0 END AS seq
    FROM events
"""

_RUNS = """
    SELECT o_custkey AS input_id, o_orderkey AS run_id, o_orderpriority AS plan, o_orderstatus AS run_values,
           o_orderkey % 5 <> 0 AS schema_ok, o_orderkey % 10 = 0 OR o_orderkey % 101 = 0 AS repair_tried, o_orderkey % 20 = 0 AS repaired, o_orderkey % 15 = 0 OR o_orderkey % 103 = 0 AS fell_back, o_orderkey % 97 = 0 AS transmitted
    FROM orders
"""

_STUDY = """
    SELECT o_orderkey AS run_id, o_custkey AS participant, o_orderpriority AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'assisted' ELSE 'manual' END AS arm,
           row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderkey % 2 ORDER BY o_orderdate, o_orderkey) AS attempt,
           CAST(floor(o_totalprice / 100) AS BIGINT) AS seconds, o_orderdate AS started_at, o_orderstatus AS outcome, o_orderkey % 9 <> 0 AS complete
    FROM orders
"""

_VERSIONS = """
    SELECT p_brand AS template_id, p_size AS major, CAST(p_partkey % 10 AS INT) AS minor, p_partkey AS patch, p_type AS document_type, p_partkey % 4 <> 0 AS active,
           CAST(p_size AS INT) AS valid_from, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS INT) + 30 END AS valid_until
    FROM part
"""

_PARTS = {"lines": (), "blocks": ("lines",), "cells": (), "actual": ("cells",), "log": (), "runs": (), "study": (), "versions": ()}
_TEXT = {"blocks": _BLOCKS, "cells": _CELLS, "actual": _ACTUAL, "log": _LOG, "runs": _RUNS, "study": _STUDY, "versions": _VERSIONS}


def with_views(dialect: str, *names: str) -> str:
    """WITH clause that defines the named views and those that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _PARTS[name]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "WITH " + ", ".join(f"{n} AS ({_LINES[dialect] if n == 'lines' else _TEXT[n]})" for n in order)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return select(spark, sf_dir, f"{with_views('spark', name)} SELECT * FROM {name}")


def duck(*names: str) -> str:
    """The same views for the SQL of a query."""
    return with_views("duckdb", *names)
