"""Registry of queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it is covered by tests on small fixtures instead."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


# The proxy graph of topicloom.plans.proxy in SQL.
GRAPH_CTES = """
hierarchy AS (
  SELECT DISTINCT parent, child FROM (
    SELECT p_brand AS parent, 'part_' || p_partkey AS child FROM part
    UNION ALL SELECT 'type_' || p_type, 'part_' || p_partkey FROM part WHERE p_size <= 25
    UNION ALL SELECT 'catalog', p_brand FROM part
    UNION ALL SELECT 'catalog', 'type_' || p_type FROM part)
),
subtopic_of AS (SELECT child AS src, parent AS dst FROM hierarchy),
topic AS (
  SELECT 'part_' || p_partkey AS name FROM part
  UNION SELECT p_brand FROM part UNION SELECT 'type_' || p_type FROM part UNION SELECT 'catalog' FROM part
),
paper AS (
  SELECT o_orderkey AS eid, 'order_' || o_orderkey AS title, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
),
jobrole AS (SELECT s_suppkey AS name FROM supplier),
post AS (SELECT event_id AS id FROM events WHERE event_type <> 'error'),
author AS (SELECT c_name AS author FROM customer UNION SELECT s_name FROM supplier),
company AS (SELECT n_name AS company_id FROM nation),
job AS (SELECT c_custkey AS job_id FROM customer),
addresses AS (SELECT DISTINCT l_orderkey AS src, 'part_' || l_partkey AS dst FROM lineitem),
requires AS (
  SELECT DISTINCT l_suppkey AS src, 'part_' || l_partkey AS dst FROM lineitem
  WHERE l_returnflag = 'R' AND l_discount >= 0.09 AND l_quantity >= 45
),
tagged AS (
  SELECT event_id AS src,
         'part_' || ((user_id * 13 + CAST(json_extract_string(props, '$.k') AS BIGINT)) % (SELECT count(*) FROM part)) AS dst
  FROM events WHERE event_type = 'view'
),
authored AS (
  SELECT c_name AS src, o_orderkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey
  UNION SELECT s_name, l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
),
posted AS (SELECT n_name AS src, c_custkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey),
has_role AS (SELECT c_custkey AS src, c_custkey % (SELECT count(*) FROM supplier) AS dst FROM customer)
"""


def on_graph(body: str, *ctes: str) -> str:
    """SQL over the proxy graph, with further common tables if given."""
    return "WITH " + ",\n".join([GRAPH_CTES.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


def rounded(expr: str, digits: int) -> str:
    """The SQL of ``round_half_up``."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,8)), {digits}) AS DOUBLE)"
