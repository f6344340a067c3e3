"""Registered queries of enrichment imports (E2, E6, E7, E9, E12-E16, R1), with DuckDB SQL after the reference's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.operators import enrichment as E
from rolegraph.plans.queries import query
from rolegraph.plans.views import parts, sql

# Candidates with stored skills; two of three have a payload, every seventeenth of which breaks a rule.
_CANDIDATES = """
SELECT candidate_id, 'Ada Lovelace' AS full_name, 'https://people.example.com/a/' || candidate_id AS normalized_profile_url, CASE WHEN candidate_id % 4 <> 0 THEN 'Engineer' END AS headline, CAST(NULL AS STRING) AS about, CAST(NULL AS STRING) AS location_raw, city, country,
  CAST(NULL AS STRING) AS current_title, CAST(NULL AS STRING) AS current_company, CAST(NULL AS STRING) AS discovery_snippet, total_experience_months, 'discovered' AS profile_status, CAST(NULL AS TIMESTAMP) AS last_scraped_at, CAST(0 AS DOUBLE) AS data_quality_score
FROM v_candidates"""
_PAYLOADS = """
SELECT candidate_id, CASE WHEN candidate_id % 2 = 0 THEN 'deep' ELSE 'basic' END AS mode, CASE candidate_id % 8 WHEN 0 THEN 'replace_all' WHEN 1 THEN 'replace_sections' WHEN 2 THEN 'replace_sections' ELSE 'merge' END AS import_mode, candidate_id % 5 = 0 AS is_partial,
  CASE candidate_id % 4 WHEN 1 THEN 'overwrite_non_null' WHEN 0 THEN CASE WHEN candidate_id % 8 = 0 THEN 'keep_existing' ELSE 'fill_empty' END ELSE 'fill_empty' END AS identity_update_strategy,
  CAST(NULL AS STRING) AS full_name, CASE WHEN candidate_id % 7 <> 0 THEN 'Chief engineer' ELSE ' ' END AS headline, CASE WHEN candidate_id % 6 = 1 THEN 'About' END AS about, CAST(NULL AS STRING) AS location_raw
FROM v_candidates WHERE candidate_id % 3 <> 0"""
_STORED = "SELECT candidate_id, raw_name, CAST(NULL AS STRING) AS category, source, 0.25 AS confidence, CAST(1 AS INT) AS endorsement_count, CAST(0 AS BIGINT) AS pos FROM v_profile_skills WHERE length(raw_name) % 2 = 0 GROUP BY candidate_id, raw_name, source"
# Order lines meet orders and parts by key, then go to their candidate's task.
_KEYED = {"lineitem": "l_orderkey", "part": "p_partkey", "v_profile_skills": "candidate_id"}
# Each row comes twice, the second time with a higher confidence; the last one of a key counts.
_INCOMING = """SELECT candidate_id, raw_name, CAST(NULL AS STRING) AS category, source, n * 0.375 AS confidence, CASE WHEN candidate_id % 17 = 0 THEN -1 ELSE CAST(n AS INT) END AS endorsement_count, n AS pos
  FROM (SELECT DISTINCT candidate_id, raw_name, source FROM v_profile_skills WHERE endorsement_count > 20) AS i JOIN (SELECT 1 AS n FROM region WHERE r_regionkey = 0 UNION ALL SELECT 2 FROM region WHERE r_regionkey = 0) AS twice ON TRUE"""

_RULES = f"""
c AS ({_CANDIDATES}), p AS ({_PAYLOADS}), old AS ({_STORED}), new AS (SELECT DISTINCT candidate_id, raw_name, source FROM ({_INCOMING})),
good AS (SELECT *, import_mode = 'replace_all' OR (import_mode = 'replace_sections' AND candidate_id % 8 = 1) AS replaces FROM p WHERE NOT (candidate_id % 17 = 0 AND candidate_id IN (SELECT candidate_id FROM new))),
fresh AS (SELECT new.* FROM new JOIN good USING (candidate_id)),
rest AS (SELECT o.candidate_id, o.raw_name, o.source FROM old o LEFT JOIN good g USING (candidate_id) WHERE NOT coalesce(g.replaces, FALSE) AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.candidate_id = o.candidate_id AND f.raw_name = o.raw_name AND f.source = o.source)),
after AS (SELECT candidate_id, raw_name, source, 0.25 AS confidence FROM rest UNION ALL SELECT candidate_id, raw_name, source, CASE source WHEN 'inferred' THEN 0.5 WHEN 'about_text' THEN 0.7 ELSE 0.75 END FROM fresh),
person AS (SELECT c.candidate_id, c.headline AS old_headline, g.candidate_id IS NOT NULL AS touched, CASE WHEN trim(g.headline) = '' OR g.candidate_id IS NULL THEN c.headline WHEN c.headline IS NULL AND g.identity_update_strategy <> 'keep_existing' THEN g.headline WHEN g.identity_update_strategy = 'overwrite_non_null' THEN g.headline ELSE c.headline END AS headline,
  CASE WHEN g.identity_update_strategy <> 'keep_existing' THEN g.about END AS about, g.mode, g.is_partial FROM c LEFT JOIN good g USING (candidate_id))"""


def _imported(spark: SparkSession, d: str, preview: bool = False):
    payloads = sql(spark, d, _PAYLOADS).withColumn("sections_present", F.when(F.col("candidate_id") % 8 == 1, F.array(F.lit("skill"))).otherwise(F.array().cast("array<string>")))
    tasks = parts(spark, d)
    rows = lambda body: sql(spark, d, body, keyed=_KEYED, tasks=tasks).withColumn("confidence", F.col("confidence").cast("double"))
    return E.import_enrichment(sql(spark, d, _CANDIDATES), {"skill": rows(_STORED)}, payloads, {"skill": rows(_INCOMING)}, "2002-06-01 00:00:00", preview=preview, tasks=tasks)


@query(f"""
WITH {_RULES},
counts AS (SELECT candidate_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM old o WHERE o.candidate_id = f.candidate_id AND o.raw_name = f.raw_name AND o.source = f.source)) AS created, count(*) AS given FROM fresh f GROUP BY 1),
was AS (SELECT candidate_id, count(*) AS n FROM old GROUP BY 1), now AS (SELECT candidate_id, count(*) AS n FROM after GROUP BY 1)
SELECT p.candidate_id, p.import_mode, CAST(coalesce(created, 0) AS BIGINT) AS created, CAST(coalesce(given - created, 0) AS BIGINT) AS updated, CAST(CASE WHEN g.replaces THEN coalesce(was.n, 0) - coalesce(given - created, 0) ELSE 0 END AS BIGINT) AS deleted,
  CASE WHEN g.candidate_id IS NULL THEN 'failed' WHEN p.is_partial THEN 'partial' ELSE 'completed' END AS status, CASE WHEN g.candidate_id IS NULL THEN 'skill:negative_endorsements' END AS errors,
  CAST(40 + CASE WHEN old_headline IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN was.n >= 3 THEN 5 ELSE 0 END AS DOUBLE) AS quality_before, CAST(40 + CASE WHEN person.headline IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN person.about IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN now.n >= 3 THEN 5 ELSE 0 END AS DOUBLE) AS quality_after
FROM p JOIN person USING (candidate_id) LEFT JOIN good g ON g.candidate_id = p.candidate_id LEFT JOIN counts ON counts.candidate_id = p.candidate_id LEFT JOIN was ON was.candidate_id = p.candidate_id LEFT JOIN now ON now.candidate_id = p.candidate_id""")
def enrichment_import(spark: SparkSession, d: str) -> DataFrame:
    """What each payload's run did, failed ones with their rules."""
    runs = _imported(spark, d)[2]
    return runs.select("candidate_id", "import_mode", F.col("skill_created").alias("created"), F.col("skill_updated").alias("updated"), F.col("skill_deleted").alias("deleted"), "status", F.array_join("errors", ",").alias("errors"), "quality_before", "quality_after")


@query(f"WITH {_RULES} SELECT candidate_id, raw_name, source, CAST(confidence AS DOUBLE) AS confidence FROM after")
def enriched_skills(spark: SparkSession, d: str) -> DataFrame:
    """The stored skills after the import."""
    return _imported(spark, d)[1]["skill"].select("candidate_id", "raw_name", "source", "confidence")


@query(f"WITH {_RULES} SELECT candidate_id, headline, about, CASE WHEN NOT touched THEN 'discovered' WHEN mode = 'deep' AND NOT is_partial THEN 'scraped' ELSE 'partial' END AS profile_status, coalesce(touched AND mode = 'deep' AND NOT is_partial, FALSE) AS scraped FROM person")
def enriched_candidates(spark: SparkSession, d: str) -> DataFrame:
    """E9 (all three strategies), E15: the candidates after the import."""
    return _imported(spark, d)[0].select("candidate_id", "headline", "about", "profile_status", F.col("last_scraped_at").isNotNull().alias("scraped"))
