"""Registered queries of discovery, links, look-ups, texts and declared rules (D3-D11, J5, L10, T9-T16, T23, T24, V1-V3), with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.functions import text as X
from rolegraph.functions import urls as U
from rolegraph.operators import imports, integrity, shortlists
from rolegraph.operators import relational as R
from rolegraph.plans.queries import _DECIDED, _FOUND, query
from rolegraph.plans.views import sql, view
from rolegraph.sources.scratch import Scratch


def _people(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_people").select("candidate_id", "normalized_profile_url", "profile_slug", "created_at")


@query("SELECT result_id, job_id FROM (SELECT result_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY normalized_url, result_id) AS n FROM v_results JOIN v_queries USING (query_id) WHERE candidate_id IS NULL) WHERE n <= 5")
def discovery_work(spark: SparkSession, d: str) -> DataFrame:
    """D3: a request of five results a job."""
    return imports.work(view(spark, d, "v_results"), view(spark, d, "v_queries"), most=5).select("result_id", "job_id")


@query(f"""
WITH {_DECIDED},
u AS (SELECT normalized_profile_url AS normalized_url, arg_min(candidate_id, (created_at, candidate_id)) AS known FROM v_people WHERE normalized_profile_url IS NOT NULL GROUP BY 1),
l AS (SELECT e.*, known, CASE WHEN eligible AND known IS NULL THEN min(result_id) OVER (PARTITION BY normalized_url, eligible, known IS NULL) END AS leader_id FROM e LEFT JOIN u USING (normalized_url))
SELECT result_id, CASE WHEN NOT eligible THEN 'would_skip' WHEN known IS NULL AND result_id = leader_id THEN 'would_create' ELSE 'would_link' END AS action, known AS candidate_id, leader_id FROM l""")
def discovery_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """A plan by exact URL only."""
    return imports.discover(sql(spark, d, _FOUND), _people(spark, d), dry_run=True).select("result_id", "action", "candidate_id", "leader_id")


_KNOWN = """u AS (SELECT normalized_profile_url AS normalized_url, arg_min(candidate_id, (created_at, candidate_id)) AS by_url FROM v_people WHERE normalized_profile_url IS NOT NULL GROUP BY 1),
s AS (SELECT lower(profile_slug) AS slug, arg_min(candidate_id, (created_at, candidate_id)) AS by_slug FROM v_people WHERE profile_slug IS NOT NULL GROUP BY 1)"""


@query(f"""
WITH {_DECIDED}, {_KNOWN},
j AS (SELECT e.*, coalesce(lower(candidate_profile_slug), normalized_url) AS identity FROM e LEFT JOIN u USING (normalized_url) LEFT JOIN s ON s.slug = lower(candidate_profile_slug) WHERE eligible AND by_url IS NULL AND by_slug IS NULL)
SELECT result_id, source, profile_slug, 'discovered' AS profile_status,
  CAST(15 + CASE WHEN k IN (0, 1, 5) THEN 15 ELSE 0 END + CASE WHEN displayed_headline IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN displayed_location IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN k IN (0, 6) THEN 20 ELSE 0 END + CASE WHEN result_id % 2 = 0 THEN 5 ELSE 0 END AS DOUBLE) AS data_quality_score
FROM (SELECT *, candidate_profile_slug AS profile_slug, row_number() OVER (PARTITION BY result_id ORDER BY normalized_url) AS n FROM (SELECT *, first_value(result_id) OVER (PARTITION BY identity ORDER BY normalized_url, result_id) AS first_id FROM j) WHERE result_id = first_id) WHERE n = 1""")
def discovered_quality(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that discovery creates, with their quality."""
    found = sql(spark, d, _FOUND)
    seen = found.select("result_id", "title", F.when(F.col("result_id") % 2 == 0, "a snippet").alias("snippet"), F.col("normalized_url").alias("source_url"))
    return imports.new_candidates(imports.discover(found, _people(spark, d)), seen).select("result_id", "source", "profile_slug", "profile_status", "data_quality_score")


@query(f"""
WITH {_DECIDED}, {_KNOWN},
w AS (SELECT result_id, normalized_url, candidate_profile_slug, reason, confidence, eligible, k, CASE WHEN result_id % 13 = 0 THEN result_id % 100 END AS linked FROM e WHERE result_id % 10 < 5),
j AS (SELECT w.*, coalesce(by_url, by_slug) AS known, coalesce(lower(candidate_profile_slug), normalized_url) AS identity FROM w LEFT JOIN u USING (normalized_url) LEFT JOIN s ON s.slug = lower(candidate_profile_slug)),
l AS (SELECT *, linked IS NULL AND eligible AND known IS NULL AS fresh, first_value(result_id) OVER (PARTITION BY identity, linked IS NULL AND eligible AND known IS NULL ORDER BY normalized_url, result_id) AS first_id FROM j)
SELECT result_id, CASE WHEN linked IS NOT NULL THEN 'linked_existing' WHEN NOT eligible THEN NULL WHEN fresh AND result_id = first_id THEN 'created' ELSE 'linked_existing' END AS action, CASE WHEN linked IS NOT NULL THEN linked ELSE known END AS candidate_id, CASE WHEN fresh THEN first_id END AS leader_id,
  CASE WHEN linked IS NOT NULL THEN 'search_result_already_linked' WHEN NOT eligible THEN reason WHEN fresh AND result_id = first_id THEN 'candidate_created' ELSE 'exact_candidate_identity_match' END AS reason, CASE WHEN linked IS NOT NULL THEN 1.0 WHEN eligible THEN confidence END AS confidence, CASE WHEN linked IS NULL AND NOT eligible THEN 'search_result_not_eligible' END AS error FROM l
UNION ALL SELECT DISTINCT -l_orderkey, NULL, NULL, NULL, NULL, NULL, 'search_result_not_found' FROM lineitem""")
def single_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Requests for results by id; every line's order adds an id that no result has."""
    found = sql(spark, d, _FOUND).withColumn("candidate_id", F.when(F.col("result_id") % 13 == 0, F.col("result_id") % 100))
    lost = view(spark, d, "lineitem").select((-F.col("l_orderkey")).alias("result_id"))
    wanted = found.filter("result_id % 10 < 5").select("result_id").unionByName(lost)
    return imports.discover_single(found, _people(spark, d), wanted)


@query("SELECT candidate_id, result_id, query_text, title AS job_title FROM v_results JOIN v_queries USING (query_id) JOIN v_jobs ON v_jobs.job_id = v_queries.job_id WHERE candidate_id IS NOT NULL")
def results_of_candidates(spark: SparkSession, d: str) -> DataFrame:
    """D10."""
    return imports.results_of_candidates(view(spark, d, "v_results"), view(spark, d, "v_queries"), view(spark, d, "v_jobs")).select("candidate_id", "result_id", "query_text", "job_title")


@query("SELECT result_id, CASE result_id % 5 WHEN 0 THEN NULL WHEN 1 THEN result_id % 1000 ELSE candidate_id END AS candidate_id FROM v_results")
def relinked_results(spark: SparkSession, d: str) -> DataFrame:
    """Of every five results one is detached and one moved."""
    results = view(spark, d, "v_results")
    changes = results.filter("result_id % 5 < 2").select("result_id", F.when(F.col("result_id") % 5 == 1, F.col("result_id") % 1000).alias("new_candidate_id"))
    return imports.relinked(results, changes).select("result_id", "candidate_id")


@query("SELECT job_id, candidate_id, total_score FROM v_matches WHERE job_id IN (SELECT job_id FROM v_jobs WHERE status = 'parsed')")
def matches_of_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Of parsed jobs."""
    return shortlists.matches_of_jobs(view(spark, d, "v_matches"), view(spark, d, "v_jobs").filter("status = 'parsed'"))


@query("SELECT candidate_id, full_name FROM v_candidates WHERE candidate_id IN (SELECT candidate_id FROM v_shortlist WHERE status = 'contacted')")
def candidates_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys that occur several times give a row once."""
    return R.by_key(view(spark, d, "v_candidates"), "candidate_id", view(spark, d, "v_shortlist").filter("status = 'contacted'")).select("candidate_id", "full_name")


# Titles of results, snippets and links of several forms, by the remainder of the order.
_TEXTS = """
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN o_clerk WHEN 1 THEN o_clerk || ' - ' || o_orderpriority || ' | LinkedIn' WHEN 2 THEN o_clerk || ' - a - b - LinkedIn' WHEN 3 THEN 'a - b - c - d' END AS title,
  CASE o_orderkey % 4 WHEN 0 THEN 'Lives in KOCAELI, works in bursa' WHEN 1 THEN 'Ankara ' || o_comment WHEN 2 THEN 'nowhere' END AS snippet, 'HTTPS://Jobs.Example.COM/' || o_orderpriority || '/?q=' || o_custkey || '#top' AS link,
  CASE o_orderkey % 4 WHEN 0 THEN 'https://Example.com:443//jobs/' || o_custkey || '/' WHEN 1 THEN 'example.com/in' WHEN 2 THEN 'example.com/?q=1' ELSE 'not a domain' END AS target,
  CASE WHEN o_orderkey % 3 = 0 THEN repeat('x', CAST(o_custkey + 1000 AS INT)) WHEN o_orderkey % 3 = 1 THEN '<HTML><body>' || o_clerk END AS evidence, o_clerk AS clerk
FROM (SELECT o_orderkey, o_custkey, o_orderpriority, 'clerk ' || (o_orderkey % 97) AS o_clerk, 'order ' || o_orderkey AS o_comment FROM orders) AS o"""


@query(f"""SELECT id, CASE id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE clerk END AS name, CASE id % 5 WHEN 1 THEN substr(title, length(clerk) + 4, length(title) - length(clerk) - 14) WHEN 2 THEN 'a' END AS headline,
  CASE id % 4 WHEN 0 THEN 'Bursa' WHEN 1 THEN 'Ankara' END AS place, 'https://jobs.example.com/' || substr(split_part(link, '/?', 1), 26) || '?' || split_part(split_part(link, '?', 2), '#', 1) AS source_url,
  CASE id % 4 WHEN 0 THEN 'example.com/jobs/' || regexp_extract(target, '(\\d+)/$', 1) WHEN 1 THEN 'example.com/in' END AS target_domain, 'https://www.google.com/search?q=' || replace(clerk, ' ', '+') AS search_url,
  'cookie=[REDACTED],user=' || clerk AS redacted, evidence IS NULL OR (length(evidence) <= 2000 AND evidence NOT LIKE '<HTML>%') AS evidence_ok FROM ({_TEXTS})""")
def result_texts(spark: SparkSession, d: str) -> DataFrame:
    """T9, T10, T12, T13, T16, T23, T24."""
    t, c = sql(spark, d, _TEXTS, dealt="orders"), F.col
    shown = X.title_parts(c("title"))
    hidden = X.redacted(F.create_map(F.lit("Cookie"), c("link"), F.lit("user"), c("clerk")))
    # By a generator, before any row goes to Python: the texts of evidence are not kept with it, nor spilled.
    t = t.select("id", "title", "snippet", "link", "target", "clerk", F.explode(F.array(X.evidence_ok(c("evidence")))).alias("evidence_ok"))
    return t.select(
        "id", shown["name"].alias("name"), shown["headline"].alias("headline"), X.place_in(c("snippet")).alias("place"), U.source_url(c("link")).alias("source_url"), U.target_domain(c("target")).alias("target_domain"), U.search_url(c("clerk")).alias("search_url"),
        F.concat(F.lit("cookie="), hidden["Cookie"], F.lit(",user="), hidden["user"]).alias("redacted"), "evidence_ok",
    )


_TABLES = {
    "job_postings": "SELECT job_id, CAST(min_years AS DOUBLE) AS min_experience_years, CASE WHEN job_id % 2 = 0 THEN 5.0 END AS max_experience_years FROM v_jobs WHERE job_id % 50 <> 0",
    "job_requirements": "SELECT job_id, CAST(req_id % 7 AS DOUBLE) / 4 AS confidence, CAST(seq - 1 AS DOUBLE) AS weight FROM v_requirements",
    "search_queries": "SELECT query_id, job_id, query_text AS normalized_query_key, created_at % 8 AS precision_level FROM v_queries",
    "search_results": "SELECT result_id, query_id, candidate_id, normalized_url, CAST(result_id % 9 AS INT) AS result_rank, CASE WHEN result_id % 3 = 0 THEN result_id + 1 END AS duplicate_of_id FROM v_results",
    "candidates": "SELECT candidate_id, total_experience_months - 3 AS total_experience_months, quality AS data_quality_score, city AS normalized_profile_url FROM v_candidates WHERE candidate_id % 20 <> 0",
    "candidate_experiences": "SELECT candidate_id, start_date, CASE WHEN sort_order % 5 = 0 THEN start_date - INTERVAL 3 DAY ELSE end_date END AS end_date, duration_months - 2 AS duration_months FROM v_experiences",
    "candidate_skills": "SELECT candidate_id, raw_name AS normalized_name, source, confidence * 2 AS confidence, endorsement_count - 10 AS endorsement_count FROM v_profile_skills",
    "candidate_matches": "SELECT job_id, candidate_id, total_score * 8 AS total_score FROM v_matches",
    "shortlist_entries": "SELECT job_id % 10 AS job_id, candidate_id FROM v_shortlist",
}
_JOINED = ("search_results", "candidate_experiences", "candidate_skills")


# Rows that break a rule, written apart from the operator's conditions.
_BROKEN = {
    ("job_postings", "min_experience_nonnegative"): "min_experience_years < 0", ("job_postings", "max_experience_nonnegative"): "max_experience_years < 0", ("job_postings", "experience_range_valid"): "min_experience_years > max_experience_years",
    ("job_requirements", "weight_nonnegative"): "weight < 0", ("job_requirements", "confidence_range"): "confidence > 1 OR confidence < 0", ("search_queries", "precision_level_range"): "precision_level IN (0, 6, 7)",
    ("search_results", "result_rank_positive"): "result_rank = 0", ("candidates", "total_experience_nonnegative"): "total_experience_months < 0", ("candidates", "data_quality_score_range"): "data_quality_score < 0 OR data_quality_score > 100",
    ("candidate_experiences", "duration_months_nonnegative"): "duration_months < 0", ("candidate_experiences", "date_range_valid"): "end_date < start_date", ("candidate_skills", "endorsement_count_nonnegative"): "endorsement_count < 0",
    ("candidate_skills", "confidence_range"): "confidence > 1 OR confidence < 0", ("candidate_matches", "total_score_range"): "total_score > 100 OR total_score < 0",
}


def _report_sql() -> str:
    """The counts of every rule over the tables above, each as a query of its own."""
    parts = []
    for table, rules in integrity.ROW_RULES.items():
        if table in _TABLES:
            for rule in rules:
                parts.append((table, rule, _BROKEN.get((table, rule), "FALSE")))
    out = [f"SELECT '{t}' AS table_name, '{r}' AS rule, count(*) FILTER ({cond}) AS n FROM t_{t}" for t, r, cond in parts]
    for table, keys in integrity.UNIQUE_KEYS.items():
        for rule, key in keys.items():
            if table in _TABLES:
                whole = " AND ".join(f"{k} IS NOT NULL" for k in key)
                out.append(f"SELECT '{table}', '{rule}', (SELECT count(*) FROM t_{table} WHERE {whole}) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(key)} FROM t_{table} WHERE {whole}))")
    for child, column, parent in integrity.REFERENCES:
        if child in _TABLES and parent in _TABLES:
            out.append(f"SELECT '{child}', 'fk_{column}', count(*) FROM t_{child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {integrity.PRIMARY_KEYS[parent]} FROM t_{parent})" if column in _TABLES[child] else f"SELECT '{child}', 'fk_{column}', 0")
    return "WITH " + ", ".join(f"t_{t} AS ({body})" for t, body in _TABLES.items()) + " " + " UNION ALL ".join(out)


@query(_report_sql())
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    """V1-V3: every declared rule of nine tables, with rows that break them."""
    tables, kept = {t: sql(spark, d, body) for t, body in _TABLES.items()}, Scratch(spark, "integrity")
    # Each rule reads its table; those that join order lines are made once, not once a rule.
    tables |= {t: kept.keep(tables[t]) for t in _JOINED}
    return integrity.report(tables).select("table_name", "rule", "n")
