"""Registered queries of result imports into empty and filled storage (I1-I4, I6), with DuckDB SQL after the reference's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.operators import imports
from rolegraph.plans.queries import query
from rolegraph.plans.views import sql, view


def _records(rows: DataFrame) -> DataFrame:
    texts = [F.lit(None).cast("string").alias(c) for c in ("title", "snippet", "displayed_name", "displayed_headline", "displayed_location")]
    return rows.select("query_id", F.col("result_id").alias("pos"), F.col("normalized_url").alias("url"), *texts, F.lit(1).alias("rank"))


@query("""
SELECT query_id, count(*) AS received, count(*) AS valid, 0 AS invalid, count(DISTINCT normalized_url) AS inserted, count(DISTINCT normalized_url) AS total,
  count(*) - count(DISTINCT normalized_url) + count(DISTINCT CASE WHEN earliest < query_id THEN normalized_url END) AS duplicate
FROM (SELECT *, min(query_id) OVER (PARTITION BY normalized_url) AS earliest FROM v_results) GROUP BY query_id""")
def import_summary(spark: SparkSession, d: str) -> DataFrame:
    """An import of several queries into empty storage."""
    return imports.import_summary(_records(view(spark, d, "v_results")))


# Every third result is stored; of the others every eleventh has no valid URL, and some have a name and a password, a port or a mark in it.
_BATCH = """SELECT result_id, query_id, CASE WHEN result_id % 11 = 0 THEN 'ftp://people.example.com/' || result_id WHEN result_id % 11 = 1 THEN replace(normalized_url, '://', '://me:pw@') || '/?utm_source=x#y' WHEN result_id % 11 = 2 THEN replace(normalized_url, '.com', '.COM:443') ELSE normalized_url END AS normalized_url
  FROM v_results WHERE result_id % 3 <> 0 AND (query_id % 2 = 0 OR result_id % 4 = 0)"""
_STORED = "SELECT DISTINCT query_id, normalized_url FROM v_results WHERE result_id % 3 = 0"
_NEW = "SELECT query_id, normalized_url AS url, count(*) AS n FROM v_results WHERE result_id % 3 <> 0 AND (query_id % 2 = 0 OR result_id % 4 = 0) AND result_id % 11 <> 0 GROUP BY ALL"


def _summary_sql(mode: str) -> str:
    gone = "FALSE" if mode == "merge" else "(s.query_id < b.query_id AND s.query_id IN (SELECT query_id FROM batch))"
    mine = "EXISTS (SELECT 1 FROM stored s WHERE s.query_id = b.query_id AND s.normalized_url = b.url)" if mode == "merge" else "FALSE"
    return f"""SELECT '{mode}' AS mode, query_id, CAST(any_value(received) AS BIGINT) AS received, CAST(coalesce(sum(n), 0) AS BIGINT) AS valid, CAST(any_value(received) - coalesce(sum(n), 0) AS BIGINT) AS invalid,
      CAST(coalesce(sum(n - 1), 0) + count(CASE WHEN mine THEN 1 END) + count(CASE WHEN NOT mine AND elsewhere THEN 1 END) AS BIGINT) AS duplicate, CAST(count(CASE WHEN NOT mine THEN 1 END) AS BIGINT) AS inserted, CAST(count(CASE WHEN NOT mine THEN 1 END) + {'any_value(coalesce(before, 0))' if mode == 'merge' else '0'} AS BIGINT) AS total
    FROM batch LEFT JOIN (SELECT b.*, {mine} AS mine, EXISTS (SELECT 1 FROM stored s WHERE s.normalized_url = b.url AND s.query_id <> b.query_id AND NOT {gone}) OR EXISTS (SELECT 1 FROM new o WHERE o.url = b.url AND o.query_id < b.query_id) AS elsewhere FROM new b) x USING (query_id)
      LEFT JOIN (SELECT query_id, count(*) AS before FROM stored GROUP BY 1) USING (query_id) GROUP BY query_id"""


@query(f"WITH stored AS ({_STORED}), new AS ({_NEW}), batch AS (SELECT query_id, count(*) AS received FROM ({_BATCH}) GROUP BY 1) {_summary_sql('merge')} UNION ALL {_summary_sql('replace')}")
def import_into_storage(spark: SparkSession, d: str) -> DataFrame:
    """Both modes of an import into filled storage."""
    records, stored = _records(sql(spark, d, _BATCH)), sql(spark, d, _STORED)
    both = [imports.import_batch(records, stored, mode)[3].withColumn("mode", F.lit(mode)) for mode in ("merge", "replace")]
    return both[0].unionByName(both[1])


@query(f"WITH stored AS ({_STORED}), new AS ({_NEW}) SELECT 'merge' AS mode, query_id, normalized_url FROM stored UNION SELECT 'merge', query_id, url FROM new UNION ALL SELECT 'replace', query_id, normalized_url FROM stored WHERE query_id NOT IN (SELECT query_id FROM ({_BATCH})) UNION ALL SELECT 'replace', query_id, url FROM new")
def import_modes(spark: SparkSession, d: str) -> DataFrame:
    """What each query has after a merge and after a replacement."""
    records, stored, out = _records(sql(spark, d, _BATCH)), sql(spark, d, _STORED), None
    for mode in ("merge", "replace"):
        new, kept, *_ = imports.import_batch(records, stored, mode)
        rows = kept.select("query_id", "normalized_url").unionByName(new.select("query_id", "normalized_url")).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out
