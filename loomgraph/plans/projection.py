"""The knowledge-graph tables as projections of the star-schema tables.

Each is one SELECT that Spark and DuckDB both read, so the oracles see exactly the rows that the operators see.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PREDICATES = ("requires", "depends_on", "contains", "supports", "connects_to", "protects_from", "feeds")

VIEWS = {
    "kg_entities": """
SELECT 'P' || p_partkey AS id, p_name || ' ' || p_partkey AS name, 'component' AS entity_type,
  CASE WHEN p_partkey % 20 = 19 THEN 'merged' WHEN p_partkey % 20 = 18 THEN 'deprecated' WHEN p_partkey % 20 < 8 THEN 'accepted' ELSE 'proposed' END AS status,
  false AS is_entrance, CAST(p_partkey AS BIGINT) AS seq FROM {part}
UNION ALL SELECT 'S' || s_suppkey, s_name, 'system', 'accepted', false, CAST(1000000000000 + s_suppkey AS BIGINT) FROM {supplier}
UNION ALL SELECT 'C' || c_custkey, c_name, 'activity', 'accepted', false, CAST(2000000000000 + c_custkey AS BIGINT) FROM {customer}
UNION ALL SELECT 'N' || n_nationkey, n_name, 'space', 'accepted', false, CAST(3000000000000 + n_nationkey AS BIGINT) FROM {nation}
UNION ALL SELECT 'R' || r_regionkey, r_name, 'space', 'accepted', r_regionkey = 0, CAST(4000000000000 + r_regionkey AS BIGINT) FROM {region}""",
    "kg_aliases": "SELECT 'P' || p_partkey AS entity_id, p_brand || ' ' || p_partkey AS alias, CAST(p_partkey AS BIGINT) AS seq FROM {part}",
    "kg_assertions": """
SELECT CAST(l_orderkey AS VARCHAR(20)) || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS id,
  'P' || l_partkey AS subject_id, 'S' || l_suppkey AS object_id,
  CASE l_linenumber WHEN 1 THEN 'requires' WHEN 2 THEN 'depends_on' WHEN 3 THEN 'contains' WHEN 4 THEN 'supports' WHEN 5 THEN 'connects_to' WHEN 6 THEN 'protects_from' ELSE 'feeds' END AS predicate,
  round(1 - 5 * l_discount, 4) AS confidence,
  CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 'physical' WHEN 1 THEN 'engineering' WHEN 2 THEN 'architectural' ELSE 'cultural' END AS knowledge_origin,
  CASE WHEN l_returnflag = 'A' THEN 'accepted' WHEN l_returnflag = 'N' THEN 'proposed' WHEN l_linestatus = 'F' THEN 'conflicted' ELSE 'deprecated' END AS status,
  'm' || (l_orderkey % 3) AS source_model, round(0.8 + 2 * l_tax, 4) AS cpc, 1 + CAST(l_quantity AS INT) % 5 AS framings, l_linestatus = 'F' AS evaluated,
  l_shipdate AS created_at, l_orderkey AS run,
  CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN '[]' WHEN 1 THEN '["residential"]' WHEN 2 THEN '["healthcare","Residential tower"]' WHEN 3 THEN '["office"]' ELSE 'not json' END AS applicability
FROM {lineitem}""",
    "kg_process": """
SELECT CAST(l_orderkey AS VARCHAR(20)) || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS id, 'P' || l_partkey AS predecessor_id, 'S' || l_suppkey AS successor_id,
  l_tax > 0.05 AS hard_constraint, 'm' || (l_orderkey % 3) AS source_model,
  CASE WHEN l_returnflag = 'A' THEN 'accepted' WHEN l_returnflag = 'N' THEN 'proposed' ELSE 'deprecated' END AS status, CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS seq
FROM {lineitem}""",
    "kg_process_dag": """
SELECT 'O' || o_orderkey AS src, 'O' || nxt AS dst FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM {orders}) x WHERE nxt IS NOT NULL""",
    "kg_cycle": "SELECT 'N' || n_nationkey AS src, 'N' || ((7 * n_nationkey + 3) % 25) AS dst FROM {nation}",
    "kg_spatial": """
SELECT 'N' || n_nationkey AS subject_id, 'accessible_from' AS relation, 'R' || n_regionkey AS object_id FROM {nation}
UNION ALL SELECT 'S' || s_suppkey, 'enclosed_by', 'N' || s_nationkey FROM {supplier}
UNION ALL SELECT 'C' || c_custkey, 'adjacent_to', 'N' || c_nationkey FROM {customer}""",
    "kg_log": """
SELECT event_id AS id, 'U' || user_id AS item_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_status, event_type AS new_status, ts AS changed_at FROM {events}""",
    "kg_constraints": """
SELECT 'K' || o_orderkey AS id, 'C' || o_custkey AS subject_id, o_orderpriority AS rule, CASE WHEN o_orderstatus = 'F' THEN 'hard' ELSE 'soft' END AS constraint_type, o_orderkey % 2 = 0 AS evaluated,
  CASE WHEN o_orderkey % 7 = 6 THEN 'deprecated' WHEN o_orderkey % 7 = 5 THEN 'conflicted' WHEN o_orderkey % 7 < 2 THEN 'accepted' ELSE 'proposed' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'physical' WHEN 1 THEN 'engineering' WHEN 2 THEN 'architectural' ELSE 'cultural' END AS knowledge_origin, round(0.5 + CAST(o_orderkey % 51 AS DOUBLE) / 100, 4) AS confidence, 'm' || (o_orderkey % 3) AS source_model, CAST(o_orderkey AS BIGINT) AS seq FROM {orders}""",
    "kg_forces": """
SELECT 'F' || s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'Increased ' WHEN 1 THEN 'Reduced ' ELSE 'Plain ' END || s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'increase' ELSE 'decrease' END AS direction,
  '["P' || s_suppkey || '","N' || s_nationkey || '","X' || s_suppkey || '"]' AS affects, CASE WHEN s_suppkey % 7 = 6 THEN 'deprecated' WHEN s_suppkey % 7 = 5 THEN 'conflicted' WHEN s_suppkey % 7 < 2 THEN 'accepted' ELSE 'proposed' END AS status, CASE s_suppkey % 4 WHEN 0 THEN 'physical' WHEN 1 THEN 'engineering' WHEN 2 THEN 'architectural' ELSE 'cultural' END AS knowledge_origin, round(0.5 + CAST(s_suppkey % 51 AS DOUBLE) / 100, 4) AS confidence, 'm' || (s_suppkey % 3) AS source_model, CAST(s_suppkey AS BIGINT) AS seq FROM {supplier}""",
    "kg_patterns": """
SELECT 'T' || p_partkey AS id, p_name || ' pattern ' || p_partkey AS name, 'P' || p_partkey AS subject_id, p_type AS problem, p_brand AS solution,
  '["F' || (p_partkey % 10) || '","none"]' AS force_ids, '["' || p_brand || '"]' AS force_descriptions, '["' || p_name || ' PATTERN ' || p_partkey || '","' || p_type || '"]' AS related_pattern_names,
  CASE WHEN p_partkey % 7 = 6 THEN 'deprecated' WHEN p_partkey % 7 = 5 THEN 'conflicted' WHEN p_partkey % 7 < 2 THEN 'accepted' ELSE 'proposed' END AS status, CASE p_partkey % 4 WHEN 0 THEN 'physical' WHEN 1 THEN 'engineering' WHEN 2 THEN 'architectural' ELSE 'cultural' END AS knowledge_origin, round(0.5 + CAST(p_partkey % 51 AS DOUBLE) / 100, 4) AS confidence, 'm' || (p_partkey % 3) AS source_model, CAST(p_partkey AS BIGINT) AS seq FROM {part}""",
    "kg_antipatterns": """
SELECT 'A' || p_partkey AS id, 'No ' || p_name AS name, 'P' || (p_partkey % 50) AS subject_id, CASE WHEN p_partkey % 7 = 6 THEN 'deprecated' WHEN p_partkey % 7 = 5 THEN 'conflicted' WHEN p_partkey % 7 < 2 THEN 'accepted' ELSE 'proposed' END AS status, CASE p_partkey % 4 WHEN 0 THEN 'physical' WHEN 1 THEN 'engineering' WHEN 2 THEN 'architectural' ELSE 'cultural' END AS knowledge_origin, round(0.5 + CAST(p_partkey % 51 AS DOUBLE) / 100, 4) AS confidence, 'm' || (p_partkey % 3) AS source_model, CAST(p_partkey AS BIGINT) AS seq FROM {part} WHERE p_partkey % 3 = 0""",
    "kg_abstractions": """
SELECT 'B' || p_partkey AS id, p_type AS statement, '["A' || p_partkey || '","Z' || (p_partkey % 9) || '"]' AS child_ids, CASE WHEN p_partkey % 7 = 6 THEN 'deprecated' WHEN p_partkey % 7 = 5 THEN 'conflicted' WHEN p_partkey % 7 < 2 THEN 'accepted' ELSE 'proposed' END AS status, CASE p_partkey % 4 WHEN 0 THEN 'physical' WHEN 1 THEN 'engineering' WHEN 2 THEN 'architectural' ELSE 'cultural' END AS knowledge_origin, round(0.5 + CAST(p_partkey % 51 AS DOUBLE) / 100, 4) AS confidence, 'm' || (p_partkey % 3) AS source_model, CAST(p_partkey AS BIGINT) AS seq FROM {part} WHERE p_partkey % 4 = 0""",
    "kg_loops": """
SELECT 'L' || o_orderkey AS id, 'C' || o_custkey AS predecessor_id, 'C' || ((7 * o_custkey + o_orderkey % 3) % 100) AS successor_id, CASE WHEN o_orderkey % 5 = 4 THEN 'deprecated' ELSE 'proposed' END AS status FROM {orders}""",
    "kg_cache": "SELECT lang AS model, source AS entity_name, text AS response FROM {documents}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql.replace("VARCHAR(20)", "STRING"), **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def with_views(sql: str) -> str:
    """sql for DuckDB, with the views it names as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ", ".join(f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v])})" for v in used)
    if not ctes:
        return sql
    recursive = re.match(r"\s*WITH RECURSIVE\b", sql)
    body = re.sub(r"^\s*WITH( RECURSIVE)?\b", ",", sql) if re.match(r"\s*WITH\b", sql) else sql
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{body if body.startswith(',') else ' ' + body}"
