"""Registered queries of stored tables that are written and read back (S8-S10) and of payload checks (S6), with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rolegraph.plans.queries import query
from rolegraph.plans.views import sql, view
from rolegraph.sources.payload_checks import payload_errors
from rolegraph.sources.scratch import Scratch
from rolegraph.sources.stored import Stored


def _stored(spark: SparkSession, schema: str, keys: list[str], rows: DataFrame) -> Stored:
    """A stored table of rows in the shared folder, deleted when the application ends."""
    table = Stored(spark, f"{Scratch(spark, 'query').folder}/{uuid.uuid4().hex}", schema, keys)
    table.overwrite(rows)
    return table


_FIRST = "SELECT query_id, normalized_url, min(result_id) AS result_id FROM v_results WHERE result_id % 3 = 0 GROUP BY query_id, normalized_url"


@query(f"WITH s AS ({_FIRST}) SELECT query_id, normalized_url, result_id FROM s UNION ALL SELECT query_id, normalized_url, min(result_id) FROM v_results r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = r.query_id AND s.normalized_url = r.normalized_url) GROUP BY 1, 2")
def stored_results(spark: SparkSession, d: str) -> DataFrame:
    """All results go into a storage that holds some of their keys."""
    table = _stored(spark, "query_id long, normalized_url string, result_id long", ["query_id", "normalized_url"], sql(spark, d, _FIRST))
    table.insert_absent(view(spark, d, "v_results"), ["result_id"])
    return table.read()


@query("""
SELECT job_id, candidate_id, CASE WHEN s.candidate_id IS NULL THEN 'v1' ELSE 'v2' END AS version, CASE WHEN s.candidate_id IS NULL THEN 'score' ELSE status END AS explanation
FROM v_matches m FULL JOIN (SELECT * FROM v_shortlist WHERE job_id % 5 = 0) s USING (job_id, candidate_id)""")
def stored_matches(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a later version replace and add to stored ones."""
    table = _stored(spark, "job_id long, candidate_id long, version string, explanation string", ["job_id", "candidate_id"], sql(spark, d, "SELECT job_id, candidate_id, 'v1' AS version, 'score' AS explanation FROM v_matches"))
    table.upsert(sql(spark, d, "SELECT job_id, candidate_id, 'v2' AS version, status AS explanation FROM v_shortlist WHERE job_id % 5 = 0"))
    return table.read()


@query("SELECT job_id, value, seq FROM v_requirements WHERE job_id % 3 <> 0 AND job_id % 7 <> 0 UNION ALL SELECT job_id, title, 9 FROM v_jobs WHERE job_id % 3 = 0")
def stored_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Some jobs get other requirements, some none."""
    table = _stored(spark, "job_id long, value string, seq int", ["job_id"], view(spark, d, "v_requirements"))
    table.replace_children(sql(spark, d, "SELECT job_id, title AS value, 9 AS seq FROM v_jobs WHERE job_id % 3 = 0"), sql(spark, d, "SELECT job_id FROM v_jobs WHERE job_id % 7 = 0"))
    return table.read()


# A payload of each order; the remainder of its key decides what is wrong with it, its price and dates what else is.
_LINES = """
SELECT o_orderkey, concat('{"candidate_id": "', o_custkey, '", "mode": "', CASE o_orderkey % 12 WHEN 8 THEN 'slow' ELSE 'deep' END, '"', CASE o_orderkey % 12 WHEN 1 THEN ', "extra": 1' WHEN 7 THEN concat(', "warnings": ["w"', repeat(', "w"', 100), ']') ELSE '' END,
  ', "identity": {"headline": {"value": "', CASE o_orderkey % 12 WHEN 6 THEN '  ' ELSE o_orderpriority END, '"}', CASE o_orderkey % 12 WHEN 2 THEN ', "age": null' ELSE '' END, '}, "experiences": [{"position_title_raw": "', repeat(o_orderpriority, CASE o_orderkey % 12 WHEN 11 THEN 300 ELSE 1 END),
  '", "start_date": "', date_format(o_orderdate, 'yyyy-MM-dd'), '", "end_date": "', date_format(last_ship, 'yyyy-MM-dd'), '", "is_current": ', CASE o_orderstatus WHEN 'O' THEN 'true' ELSE 'false' END, '}], "skills": [{"raw_name": "a", "confidence": ', CAST(o_totalprice AS DECIMAL(18, 2)) / 200000, '}',
  CASE o_orderkey % 12 WHEN 3 THEN ', {"category": "c"}' WHEN 4 THEN ', 5' ELSE '' END, ']', CASE o_orderkey % 12 WHEN 9 THEN '' ELSE '}' END) AS value
FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) AS s ON l_orderkey = o_orderkey"""


@query("""
WITH o AS (SELECT *, o_orderkey % 12 AS k FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey)
SELECT o_orderkey, section, pos, field, reason FROM o JOIN (VALUES (1, 'payload', NULL, 'extra', 'unknown_key'), (2, 'identity', NULL, 'age', 'unknown_key'), (3, 'skills', 1, 'raw_name', 'missing'), (4, 'skills', 1, NULL, 'wrong_type'), (6, 'identity', NULL, 'headline.value', 'too_short'),
  (7, 'payload', NULL, 'warnings', 'too_many'), (8, 'payload', NULL, 'mode', 'not_listed'), (9, 'payload', NULL, NULL, 'invalid_json'), (11, 'experiences', 0, 'position_title_raw', 'too_long')) v(n, section, pos, field, reason) ON n = k
UNION ALL SELECT o_orderkey, 'skills', 0, 'confidence', 'out_of_range' FROM o WHERE k <> 9 AND o_totalprice > 200000
UNION ALL SELECT o_orderkey, 'experiences', 0, 'end_date', CASE WHEN CAST(last_ship AS DATE) < CAST(o_orderdate AS DATE) THEN 'end_before_start' ELSE 'current_with_end' END FROM o WHERE k <> 9 AND (CAST(last_ship AS DATE) < CAST(o_orderdate AS DATE) OR o_orderstatus = 'O')""")
def payload_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Everything that is wrong in a payload of each order."""
    return payload_errors(sql(spark, d, _LINES), "o_orderkey")
