"""The registered queries of the recruiting operators, each with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolegraph.functions import text as X
from rolegraph.functions.urls import canonical_url, without_query
from rolegraph.operators import candidates as C
from rolegraph.operators import enrichment as E
from rolegraph.operators import extraction, imports, matching, shortlists, sourcing
from rolegraph.operators import relational as R
from rolegraph.plans.views import oracle, sql, view
from rolegraph.sources import pages as P
from rolegraph.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TODAY = "2002-06-01"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = oracle(sql)
        return fn

    return add


_MATCH = """
WITH p AS (SELECT DISTINCT job_id, candidate_id FROM v_results JOIN v_queries USING (query_id) WHERE candidate_id IS NOT NULL),
pj AS (SELECT p.* FROM p JOIN v_jobs j ON j.job_id = p.job_id WHERE status = 'parsed'),
sim AS (SELECT a.v AS a, b.v AS b, CASE WHEN a.v = b.v THEN 100.0 ELSE 100.0 * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END AS s
        FROM (SELECT DISTINCT v, list_distinct(string_split(v, ' ')) AS t FROM (SELECT value AS v FROM v_requirements UNION SELECT title FROM v_jobs)) a, (SELECT DISTINCT v, list_distinct(string_split(v, ' ')) AS t FROM (SELECT value AS v FROM v_skills UNION SELECT title FROM v_titles)) b),
ts AS (SELECT pj.job_id, pj.candidate_id, max(s) AS title_score FROM pj JOIN v_jobs j ON j.job_id = pj.job_id JOIN v_titles t ON t.candidate_id = pj.candidate_id JOIN sim ON sim.a = j.title AND sim.b = t.title GROUP BY ALL),
rs AS (SELECT pj.job_id, pj.candidate_id, r.req_id, CASE WHEN r.importance = 'required' THEN 2.0 ELSE 1.0 END AS w, coalesce(max(s), 0) >= 85 AS found
       FROM pj JOIN v_requirements r ON r.job_id = pj.job_id LEFT JOIN v_skills k ON k.candidate_id = pj.candidate_id LEFT JOIN sim ON sim.a = r.value AND sim.b = k.value GROUP BY pj.job_id, pj.candidate_id, r.req_id, r.importance),
ss AS (SELECT job_id, candidate_id, 100 * sum(CASE WHEN found THEN w ELSE 0 END) / sum(w) AS skill_score FROM rs GROUP BY ALL),
q AS (SELECT pj.job_id, pj.candidate_id, coalesce(title_score, 0) AS title_score, skill_score,
        CASE WHEN total_experience_months IS NULL THEN 0.0 ELSE least(100.0, 100 * (total_experience_months / 12) / greatest(min_years, 0.1)) END AS experience_score, CASE WHEN j.city = c.city THEN 100.0 WHEN j.country = c.country THEN 60.0 ELSE 0.0 END AS location_score
      FROM pj JOIN v_jobs j ON j.job_id = pj.job_id JOIN v_candidates c ON c.candidate_id = pj.candidate_id JOIN ss ON ss.job_id = pj.job_id AND ss.candidate_id = pj.candidate_id LEFT JOIN ts ON ts.job_id = pj.job_id AND ts.candidate_id = pj.candidate_id),
t AS (SELECT *, round(title_score * 0.15 + skill_score * 0.3 + experience_score * 0.15 + 10.0 + 10.0 + location_score * 0.1 + 5.0 + 5.0, 2) AS total_score FROM q)
"""


def _match(spark: SparkSession, d: str) -> DataFrame:
    jobs = view(spark, d, "v_jobs").withColumn("min_experience_years", F.col("min_years").cast("double"))
    pairs = matching.pairs(view(spark, d, "v_results"), view(spark, d, "v_queries"))
    return matching.score(pairs, jobs, view(spark, d, "v_requirements"), view(spark, d, "v_candidates"), view(spark, d, "v_titles"), view(spark, d, "v_skills"))


@query(_MATCH + "SELECT job_id, candidate_id, title_score, skill_score, experience_score, location_score, total_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY total_score DESC, candidate_id) AS rank FROM t) WHERE rank <= 5")
def match_top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The five best candidates of each parsed job."""
    ranked = matching.listing(_match(spark, d), view(spark, d, "v_candidates").select("candidate_id", "source", "profile_status"))
    return ranked.filter("rank <= 5").select("job_id", "candidate_id", "title_score", "skill_score", "experience_score", "location_score", "total_score", "rank")


@query(_MATCH + "SELECT job_id, candidate_id, total_score, CAST(round_even(total_score, 0) AS INT) AS shown FROM t")
def match_explained(spark: SparkSession, d: str) -> DataFrame:
    """Every match's total and the whole number that its explanation shows."""
    return _match(spark, d).select("job_id", "candidate_id", "total_score", F.regexp_extract("explanation", r"%(\d+)", 1).cast("int").alias("shown"))


# What of each match is matched, missing and uncertain, as category=value/importance/score in order.
_EVIDENCE = """,
skilled AS (SELECT DISTINCT candidate_id FROM v_skills), titled AS (SELECT DISTINCT candidate_id FROM v_titles),
ev AS (SELECT rs.job_id, rs.candidate_id, string_agg('skill=' || raw_value || '/' || importance || '/', '|' ORDER BY seq) FILTER (found) AS has, string_agg('skill=' || raw_value || '/' || importance || '/', '|' ORDER BY seq) FILTER (NOT found) AS lacks FROM rs JOIN v_requirements r ON r.req_id = rs.req_id GROUP BY ALL)
SELECT t.job_id, t.candidate_id,
  concat_ws('|', CASE WHEN title_score >= 70 THEN 'title=' || j.title || '//' || round_even(title_score, 1) END, has, CASE WHEN total_experience_months / 12 >= min_years THEN 'experience=' || CAST(min_years AS DOUBLE) || '//' END, CASE WHEN j.city = c.city THEN 'location=' || c.city || '//' WHEN j.country = c.country THEN 'location=' || c.country || '//' END) AS matched,
  concat_ws('|', CASE WHEN title_score < 70 AND titled.candidate_id IS NOT NULL THEN 'title=' || j.title || '//' || round_even(title_score, 1) END, CASE WHEN skilled.candidate_id IS NOT NULL THEN lacks END, CASE WHEN total_experience_months / 12 < min_years THEN 'experience=' || CAST(min_years AS DOUBLE) || '//' END, CASE WHEN j.city <> c.city AND j.country <> c.country THEN 'location=' || j.city || '//' END) AS missing,
  concat_ws('|', CASE WHEN titled.candidate_id IS NULL THEN 'candidate_title_missing' END, CASE WHEN skilled.candidate_id IS NULL THEN 'candidate_skills_missing' END, CASE WHEN total_experience_months IS NULL THEN 'candidate_duration_missing' END) AS uncertain
FROM t JOIN v_jobs j ON j.job_id = t.job_id JOIN v_candidates c ON c.candidate_id = t.candidate_id LEFT JOIN ev ON ev.job_id = t.job_id AND ev.candidate_id = t.candidate_id LEFT JOIN skilled ON skilled.candidate_id = t.candidate_id LEFT JOIN titled ON titled.candidate_id = t.candidate_id"""


@query(_MATCH.rstrip() + _EVIDENCE)
def match_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The ordered evidence of every match."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["category"], F.lit("="), x["value"], F.lit("/"), F.coalesce(x["importance"], F.lit("")), F.lit("/"), F.coalesce(x["score"].cast("string"), F.lit("")))), "|")
    return _match(spark, d).select("job_id", "candidate_id", text("matched").alias("matched"), text("missing").alias("missing"), F.array_join("uncertain.reason", "|").alias("uncertain"))


@query(_MATCH + "SELECT job_id, candidate_id, total_score, 'rule-v1' AS version FROM t UNION ALL SELECT job_id, candidate_id, total_score, 'old' FROM v_matches m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.job_id = m.job_id AND t.candidate_id = m.candidate_id)")
def match_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Scores replace those that are stored for the same job and candidate."""
    old = view(spark, d, "v_matches").withColumn("version", F.lit("old"))
    return matching.stored(old, _match(spark, d).select(old.columns))


@query("SELECT job_id, candidate_id, total_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY total_score DESC NULLS FIRST, candidate_id) AS rank FROM v_matches) WHERE rank BETWEEN 21 AND 40")
def match_second_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each job's second page of twenty."""
    return R.page_each(view(spark, d, "v_matches"), "job_id", "total_score", "candidate_id", matching.SORTS, descending=True, number=2)[0]


@query("SELECT job_id, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, 1 AS page, 20 AS page_size FROM v_shortlist GROUP BY job_id")
def shortlist_pages(spark: SparkSession, d: str) -> DataFrame:
    """How many entries and pages each job's shortlist has."""
    return R.page_each(view(spark, d, "v_shortlist"), "job_id", "created_at", "candidate_id", shortlists.SORTS)[1]


@query("SELECT req.job_id, count(*) AS pairs, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS same FROM (SELECT job_id, list_sort(string_split(value, ' ')) AS a FROM v_requirements) req JOIN (SELECT DISTINCT list_sort(string_split(value, ' ')) AS b FROM v_skills) s ON len(list_intersect(a, b)) > 0 GROUP BY req.job_id")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """M3: requirement and skill token sets that share a token, and how many of those are equal."""
    req = view(spark, d, "v_requirements").select("job_id", F.array_sort(matching.tokens(matching.key(F.col("value")))).alias("a"))
    return matching.overlaps(req, view(spark, d, "v_skills").select(F.array_sort(matching.tokens(matching.key(F.col("value")))).alias("b")).distinct())


@query("SELECT j.job_id, title, (SELECT count(*) FROM v_requirements r WHERE r.job_id = j.job_id) AS n_requirements, (SELECT count(*) FROM v_queries q WHERE q.job_id = j.job_id) AS n_queries, (SELECT count(*) FROM v_results s WHERE s.query_id = j.job_id) AS n_results FROM v_jobs j")
def jobs_with_counts(spark: SparkSession, d: str) -> DataFrame:
    """L1."""
    return R.with_counts(view(spark, d, "v_jobs").select("job_id", "title"), "job_id", {"n_requirements": (view(spark, d, "v_requirements"), "job_id"), "n_queries": (view(spark, d, "v_queries"), "job_id"), "n_results": (view(spark, d, "v_results"), "query_id")})


@query("SELECT job_id, title, status, salary FROM v_jobs WHERE lower(status) = 'parsed' AND (lower(title) LIKE '%ring%' OR lower(company) LIKE '%ring%') AND salary >= 910 AND salary <= 2000 AND source_url IS NOT NULL")
def jobs_filtered(spark: SparkSession, d: str) -> DataFrame:
    """L2-L5."""
    j = R.equals(view(spark, d, "v_jobs"), status="PARSED")
    return R.flagged(R.between(R.contains(j, "Ring", ["title", "company"]), "salary", 910.0, 2000.0), "source_url", True).select("job_id", "title", "status", "salary")


@query("SELECT candidate_id, city FROM v_candidates c WHERE EXISTS (SELECT 1 FROM v_skills s WHERE s.candidate_id = c.candidate_id) AND NOT EXISTS (SELECT 1 FROM v_titles t WHERE t.candidate_id = c.candidate_id)")
def candidates_with_skills_without_titles(spark: SparkSession, d: str) -> DataFrame:
    """L6."""
    c = R.having(view(spark, d, "v_candidates").select("candidate_id", "city"), view(spark, d, "v_skills"), "candidate_id", "candidate_id")
    return R.having(c, view(spark, d, "v_titles"), "candidate_id", "candidate_id", exists=False)


@query("SELECT job_id, source_url FROM v_jobs ORDER BY source_url DESC NULLS FIRST, job_id LIMIT 20 OFFSET 40")
def jobs_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of twenty."""
    return R.page(view(spark, d, "v_jobs").select("job_id", "source_url"), "source_url", "job_id", ["source_url"], descending=True, number=3)[0]


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, 3 AS page, 20 AS page_size FROM v_jobs")
def jobs_page_meta(spark: SparkSession, d: str) -> DataFrame:
    """Page metadata."""
    return R.page(view(spark, d, "v_jobs"), "job_id", "job_id", ["job_id"], number=3)[1]


@query("SELECT owner, count(*) AS n FROM v_results JOIN v_queries USING (query_id) GROUP BY owner")
def results_by_owner(spark: SparkSession, d: str) -> DataFrame:
    """L8."""
    return R.count_by(view(spark, d, "v_results"), view(spark, d, "v_queries"), "query_id", "owner")


@query("SELECT job_id, first_id, copies FROM (SELECT job_id, min(job_id) OVER w AS first_id, count(*) OVER w AS copies FROM v_jobs WINDOW w AS (PARTITION BY lower(trim(company)), lower(trim(title)), source, source_url IS NULL, coalesce(source_url, lower(trim(description))))) WHERE copies > 1")
def job_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """L9."""
    return R.job_duplicates(view(spark, d, "v_jobs"))


@query("SELECT 'requirements' AS child, count(*) AS n, count(job_id) AS linked FROM v_requirements WHERE job_id NOT IN (SELECT job_id FROM v_jobs WHERE status = 'draft') UNION ALL SELECT 'results', count(*), count(CASE WHEN candidate_id % 5 <> 0 THEN candidate_id END) FROM v_results")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Requirements of draft jobs go with them; results forget deleted candidates."""
    a = R.cascade(view(spark, d, "v_jobs").filter("status = 'draft'"), "job_id", {"requirements": (view(spark, d, "v_requirements"), "job_id", "cascade")})["requirements"]
    b = R.cascade(view(spark, d, "v_candidates").filter("candidate_id % 5 = 0"), "candidate_id", {"results": (view(spark, d, "v_results"), "candidate_id", "set_null")})["results"]
    total = lambda df, name, c: df.agg(F.count(F.lit(1)).alias("n"), F.count(c).alias("linked")).select(F.lit(name).alias("child"), "n", "linked")
    return total(a, "requirements", "job_id").unionByName(total(b, "results", "candidate_id"))


@query("SELECT coalesce(nullif(trim(source_url), ''), 'unknown') AS value, count(*) AS n FROM v_jobs GROUP BY 1")
def url_distribution(spark: SparkSession, d: str) -> DataFrame:
    """A1."""
    return R.distribution(view(spark, d, "v_jobs"), "source_url")


@query("SELECT b AS bucket, (SELECT count(*) FROM v_matches WHERE CASE WHEN total_score < 60 THEN 'low' WHEN total_score < 80 THEN 'medium' ELSE 'high' END = b) AS n FROM (VALUES ('low'), ('medium'), ('high')) AS t(b)")
def score_buckets(spark: SparkSession, d: str) -> DataFrame:
    """A2."""
    return R.buckets(view(spark, d, "v_matches"), "total_score")


@query("SELECT count(*) AS jobs, count(*) FILTER (status = 'parsed') AS jobs_parsed, count(*) FILTER (status = 'sourcing') AS jobs_sourcing, count(*) FILTER (status = 'completed') AS jobs_completed, (SELECT count(*) FROM v_candidates) AS candidates FROM v_jobs")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """A3."""
    return R.dashboard(view(spark, d, "v_jobs"), view(spark, d, "v_candidates"))


@query("SELECT req_id, coalesce(CASE WHEN req_id % 3 = 0 THEN raw_value END, CASE WHEN req_id % 2 = 0 THEN value END, category) AS label FROM v_requirements")
def requirement_labels(spark: SparkSession, d: str) -> DataFrame:
    """A4."""
    r = F.struct(F.when(F.col("req_id") % 3 == 0, F.col("raw_value")).alias("label"), F.when(F.col("req_id") % 2 == 0, F.col("value")).alias("value"), F.col("category").alias("type"))
    return view(spark, d, "v_requirements").select("req_id", R.requirement_label(r).alias("label"))


RULES = {"quality_nonnegative": "quality >= 0", "months_known": "total_experience_months IS NOT NULL", "status_listed": "profile_status IN ('scraped')", "name_length": "length(full_name) <= 30"}


@query("SELECT rule, n FROM (SELECT 'quality_nonnegative' AS rule, count(*) FILTER (NOT quality >= 0) AS n FROM v_candidates UNION ALL SELECT 'months_known', count(*) FILTER (total_experience_months IS NULL) FROM v_candidates UNION ALL SELECT 'status_listed', count(*) FILTER (profile_status <> 'scraped') FROM v_candidates UNION ALL SELECT 'name_length', count(*) FILTER (length(full_name) > 30) FROM v_candidates) WHERE n > 0")
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    """V1."""
    return R.violation_counts(view(spark, d, "v_candidates"), RULES)


@query("SELECT normalized_url, count(*) AS n FROM v_results GROUP BY 1 HAVING count(*) > 1")
def repeated_urls(spark: SparkSession, d: str) -> DataFrame:
    """V2."""
    return R.repeated_keys(view(spark, d, "v_results"), ["normalized_url"])


@query("SELECT job_id, candidate_id FROM v_shortlist s WHERE NOT EXISTS (SELECT 1 FROM v_matches m WHERE m.candidate_id = s.candidate_id)")
def shortlist_orphans(spark: SparkSession, d: str) -> DataFrame:
    """V3."""
    return R.orphans(view(spark, d, "v_shortlist"), "candidate_id", view(spark, d, "v_matches"), "candidate_id").select("job_id", "candidate_id")


@query("SELECT s.job_id, s.candidate_id, s.status, c.city, m.total_score FROM v_shortlist s JOIN v_candidates c ON c.candidate_id = s.candidate_id LEFT JOIN v_matches m ON m.job_id = s.job_id AND m.candidate_id = s.candidate_id WHERE s.status IN ('shortlisted', 'reviewed') AND lower(concat_ws(chr(10), full_name, note)) LIKE '%high%'")
def shortlist_listing(spark: SparkSession, d: str) -> DataFrame:
    """J4."""
    c = view(spark, d, "v_candidates").select("candidate_id", "full_name", "city", F.lit(None).cast("string").alias("headline"))
    return shortlists.listing(view(spark, d, "v_shortlist"), c, view(spark, d, "v_matches"), ["shortlisted", "reviewed"], text="HIGH").select("job_id", "candidate_id", "status", "city", "total_score")


@query("WITH x AS (SELECT status AS from_status, lead(status) OVER (PARTITION BY job_id ORDER BY candidate_id) AS to_status FROM v_shortlist) SELECT from_status, to_status, from_status = to_status OR (from_status, to_status) IN (('shortlisted', 'reviewed'), ('shortlisted', 'rejected'), ('shortlisted', 'contacted'), ('reviewed', 'shortlisted'), ('reviewed', 'rejected'), ('reviewed', 'contacted'), ('contacted', 'reviewed'), ('contacted', 'rejected'), ('rejected', 'shortlisted'), ('rejected', 'reviewed')) AS allowed, count(*) AS n FROM x WHERE to_status IS NOT NULL GROUP BY ALL")
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    """J3."""
    s = view(spark, d, "v_shortlist").select(F.col("status").alias("from_status"), F.lead("status").over(Window.partitionBy("job_id").orderBy("candidate_id")).alias("to_status")).filter("to_status is not null")
    return shortlists.checked(s, "shortlist").groupBy("from_status", "to_status", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s.job_id, s.candidate_id, CASE WHEN s.candidate_id % 3 = 0 THEN 'rejected' ELSE status END AS status, CASE WHEN s.candidate_id % 6 = 0 THEN NULL ELSE note END AS note FROM v_shortlist s")
def shortlist_updates(spark: SparkSession, d: str) -> DataFrame:
    """A change set with statuses, and notes for some."""
    s = view(spark, d, "v_shortlist")
    changes = s.filter("candidate_id % 3 = 0").select("job_id", "candidate_id", F.lit("rejected").alias("new_status"), (F.col("candidate_id") % 2 == 0).alias("note_set"), F.lit(None).cast("string").alias("new_note"))
    return shortlists.updated(s, changes).select("job_id", "candidate_id", "status", "note")


@query("SELECT job_id, candidate_id, CASE WHEN job_id % 2 = 0 THEN 'new' ELSE status END AS status FROM v_shortlist")
def shortlist_upsert(spark: SparkSession, d: str) -> DataFrame:
    """J1, S9."""
    s = view(spark, d, "v_shortlist").select("job_id", "candidate_id", "status")
    return shortlists.add_or_update(s, s.filter("job_id % 2 = 0").withColumn("status", F.lit("new")))


@query("SELECT job_id, count(*) AS n, sum(seq) AS seqs FROM (SELECT job_id, seq FROM v_requirements WHERE job_id % 3 <> 0 UNION ALL SELECT job_id, 9 FROM v_jobs WHERE job_id % 3 = 0) GROUP BY job_id")
def requirement_replacement(spark: SparkSession, d: str) -> DataFrame:
    """S10."""
    stored = view(spark, d, "v_requirements").select("job_id", "seq")
    new = view(spark, d, "v_jobs").filter("job_id % 3 = 0").select("job_id", F.lit(9).alias("seq"))
    return S.replace_children(stored, new, "job_id").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


@query("SELECT 'jobs' AS table_name, count(*) AS n FROM v_jobs UNION ALL SELECT 'results', count(*) FROM v_results UNION ALL SELECT 'shortlist', count(*) FROM v_shortlist")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """S11."""
    return S.table_counts({"jobs": view(spark, d, "v_jobs"), "results": view(spark, d, "v_results"), "shortlist": view(spark, d, "v_shortlist")})


@query("SELECT job_id, n, full_name, note, total_score, created_at FROM (SELECT s.job_id, row_number() OVER (PARTITION BY s.job_id ORDER BY s.created_at, s.candidate_id) AS n, CASE WHEN s.candidate_id % 4 = 0 THEN '''=' || full_name ELSE full_name END AS full_name, coalesce(note, '') AS note, CASE WHEN m.candidate_id IS NULL THEN '' ELSE 'scored' END AS total_score, strftime(s.created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM v_shortlist s JOIN v_candidates c ON c.candidate_id = s.candidate_id LEFT JOIN v_matches m ON m.job_id = s.job_id AND m.candidate_id = s.candidate_id)")
def shortlist_export(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth name is a spreadsheet formula, which the export guards."""
    c = view(spark, d, "v_candidates").select("candidate_id", F.when(F.col("candidate_id") % 4 == 0, F.concat(F.lit("="), "full_name")).otherwise(F.col("full_name")).alias("full_name"))
    rows = shortlists.listing(view(spark, d, "v_shortlist"), c, view(spark, d, "v_matches")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    out = S.shortlist_export(rows)
    return out.select("job_id", "n", F.col("candidate_name").alias("full_name"), F.col("recruiter_note").alias("note"), F.when(F.col("match_score") != "", "scored").otherwise("").alias("total_score"), "created_at")


@query("SELECT result_id, other AS is_duplicate, CASE WHEN other THEN f_result END AS duplicate_of_id FROM (SELECT r.result_id, f.query_id <> r.query_id AS other, f.result_id AS f_result FROM v_results r JOIN (SELECT normalized_url, result_id, query_id FROM (SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY discovered_at, result_id) AS n FROM v_results) WHERE n = 1) f ON f.normalized_url = r.normalized_url)")
def cross_query_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """I5."""
    return imports.cross_query_duplicates(view(spark, d, "v_results")).select("result_id", "is_duplicate", "duplicate_of_id")


@query("SELECT query_id, count(result_id) AS result_count, max(discovered_at) AS executed_at, CASE WHEN count(result_id) > 0 THEN 'completed' ELSE 'draft' END AS status FROM v_queries LEFT JOIN v_results USING (query_id) GROUP BY query_id")
def query_recount(spark: SparkSession, d: str) -> DataFrame:
    """I7."""
    return imports.recounted(view(spark, d, "v_queries").select("query_id", F.lit("draft").alias("status")), view(spark, d, "v_results")).select("query_id", "result_count", "executed_at", "status")


@query("SELECT owner AS job_id, count(DISTINCT normalized_url) AS distinct_urls FROM v_results JOIN v_queries USING (query_id) GROUP BY owner")
def distinct_urls(spark: SparkSession, d: str) -> DataFrame:
    """I8."""
    return imports.distinct_urls(view(spark, d, "v_results"), view(spark, d, "v_queries").withColumn("job_id", F.col("owner")))


@query("SELECT query_id, CASE WHEN n = 1 THEN k ELSE k || ':' || query_id END AS normalized_query_key FROM (SELECT query_id, lower(query_text) AS k, row_number() OVER (PARTITION BY owner, lower(query_text) ORDER BY created_at, query_id) AS n FROM v_queries)")
def query_key_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Q10."""
    return sourcing.backfilled_keys(view(spark, d, "v_queries").withColumn("job_id", F.col("owner"))).select("query_id", "normalized_query_key")


@query("""
SELECT job_id, 'site:linkedin.com/in ' || CASE WHEN lower(title) = title THEN '"' || title || '"' ELSE '("' || title || '" OR "' || lower(title) || '")' END || ' ' ||
       CASE WHEN t IS NULL OR s IS NULL OR t = s THEN '"' || coalesce(t, s) || '"' ELSE '("' || t || '" OR "' || s || '")' END || ' ("' || city || '" OR "' || country || '")' AS query_text
FROM (SELECT j.job_id, j.title, j.city, j.country, (SELECT max(r.value) FROM v_requirements r WHERE r.job_id = j.job_id AND r.seq = 0 AND r.importance = 'required') AS t, (SELECT max(r.value) FROM v_requirements r WHERE r.job_id = j.job_id AND r.seq = 1 AND r.importance = 'required') AS s FROM v_jobs j) AS x
WHERE t IS NOT NULL OR s IS NOT NULL
""")
def precision_queries(spark: SparkSession, d: str) -> DataFrame:
    """Q1-Q8: each job's strictest English query."""
    req = view(spark, d, "v_requirements").select("job_id", F.lit("skill").alias("type"), F.col("value").alias("normalized_value"), "importance", (3.0 - F.col("seq")).alias("weight"), F.lit(0.9).alias("confidence"), F.col("seq").cast("long").alias("seq"))
    none = F.array().cast("array<string>")
    jobs = view(spark, d, "v_jobs").select("job_id", F.col("title").alias("job_title"), "city", "country", none.alias("required_skills"), none.alias("preferred_skills"))
    made = sourcing.generate(sourcing.query_inputs(jobs, req), languages=("en",))
    return made.filter("query_type = 'precision'").select("job_id", "query_text")


@query("SELECT a.candidate_id AS base_id, count(DISTINCT b.candidate_id) AS others FROM v_people a JOIN v_people b ON a.candidate_id <> b.candidate_id AND (a.normalized_profile_url = b.normalized_profile_url OR a.profile_slug = b.profile_slug OR a.full_name = b.full_name) GROUP BY 1")
def duplicate_blocking(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates share a key with each."""
    return C.blocked_counts(view(spark, d, "v_people"))


_DUPLICATES = """
WITH p AS (SELECT DISTINCT a.candidate_id AS base_id, b.candidate_id AS other_id,
  CASE WHEN a.normalized_profile_url = b.normalized_profile_url THEN 1.0 WHEN a.profile_slug = b.profile_slug THEN 0.99 WHEN a.full_name = b.full_name AND a.headline = b.headline AND a.city = b.city THEN 0.95 WHEN a.full_name = b.full_name AND a.current_company = b.current_company THEN 0.9 WHEN a.full_name = b.full_name AND (a.headline = b.headline OR a.city = b.city) THEN 0.85 END AS score
  FROM v_people a JOIN v_people b ON a.candidate_id <> b.candidate_id AND (a.normalized_profile_url = b.normalized_profile_url OR a.profile_slug = b.profile_slug OR a.full_name = b.full_name))
SELECT base_id, other_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY score DESC, other_id) AS rank FROM p WHERE score >= {least}) WHERE rank <= 3
"""


@query(_DUPLICATES.format(least=0.87))
def duplicate_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate's three best duplicates."""
    return C.best_duplicates(view(spark, d, "v_people"), 0.87, 3).select("base_id", "other_id", "score", "rank")


@query(_DUPLICATES.format(least=0.8))
def duplicate_near_names(spark: SparkSession, d: str) -> DataFrame:
    """With the pairs whose names and one more field agree, below the sure ones."""
    return C.best_duplicates(view(spark, d, "v_people"), 0.8, 3).select("base_id", "other_id", "score", "rank")


@query("""
SELECT cluster_id, first(full_name ORDER BY k, ord) FILTER (trim(full_name) <> '') AS full_name, first(headline ORDER BY k, ord) FILTER (trim(headline) <> '') AS headline, first(city ORDER BY k, ord) FILTER (trim(city) <> '') AS city,
  concat_ws(',', CASE WHEN count(DISTINCT CASE WHEN trim(full_name) <> '' THEN full_name END) > 1 THEN 'full_name' END, CASE WHEN count(DISTINCT headline) > 1 THEN 'headline' END, CASE WHEN count(DISTINCT city) > 1 THEN 'city' END) AS conflicts
FROM (SELECT *, CASE WHEN strategy = 'prefer_newest' THEN -epoch_us(updated_at) ELSE 0 END AS k FROM v_members) GROUP BY cluster_id
""")
def survivorship(spark: SparkSession, d: str) -> DataFrame:
    """The orders of a customer as one cluster."""
    out = C.survivorship(view(spark, d, "v_members"), ["full_name", "headline", "city"])
    return out.select("cluster_id", "full_name", "headline", "city", F.array_join("conflicts", ",").alias("conflicts"))


@query("SELECT o_custkey % 300 AS target_id, count(*) FILTER (o_custkey >= 300) AS moved FROM orders GROUP BY 1 HAVING moved > 0")
def moved_children(spark: SparkSession, d: str) -> DataFrame:
    """Orders move from merged customers to their targets."""
    plan = view(spark, d, "customer").filter("c_custkey >= 300").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") % 300).alias("target_id"))
    return C.moved(view(spark, d, "orders").withColumnRenamed("o_custkey", "candidate_id"), plan)[1]


@query("SELECT candidate_id, lower(raw_name) AS normalized_name, source, max(confidence) AS confidence, max(endorsement_count) AS endorsement_count FROM v_profile_skills GROUP BY ALL")
def merged_skills(spark: SparkSession, d: str) -> DataFrame:
    """R10."""
    return C.merged_skills(view(spark, d, "v_profile_skills").withColumn("normalized_name", F.col("raw_name")))


@query("SELECT job_id, candidate_id, status, string_agg(note, '|' ORDER BY ord) AS note FROM (SELECT o_orderkey % 20 AS job_id, o_custkey % 300 AS candidate_id, first(o_orderstatus ORDER BY o_orderkey) OVER (PARTITION BY o_orderkey % 20, o_custkey % 300 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS status, 'note ' || o_orderkey AS note, o_orderkey AS ord FROM orders) GROUP BY job_id, candidate_id, status")
def merged_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """Entries of merged candidates; the labels between notes are shown as bars."""
    e = view(spark, d, "orders").select((F.col("o_orderkey") % 20).alias("job_id"), (F.col("o_custkey") % 300).alias("candidate_id"), F.col("o_orderkey").alias("ord"), F.lit("merged").alias("label"), F.concat(F.lit("note "), F.col("o_orderkey").cast("string")).alias("note"), F.col("o_orderstatus").alias("status"))
    return C.merged_entries(e, "note").select("job_id", "candidate_id", "status", F.replace("note", F.lit("\n\n[merged]\n"), F.lit("|")).alias("note"))


@query("SELECT candidate_id, round(total_experience_months / 12, 2) AS experience_years FROM v_candidates")
def experience_years(spark: SparkSession, d: str) -> DataFrame:
    """R18."""
    c = view(spark, d, "v_candidates").withColumns({"headline": F.lit("x"), "current_title": F.lit("x"), "current_company": F.lit("x")})
    return C.profile_flags(c, view(spark, d, "v_experiences")).select("candidate_id", "experience_years")


@query(f"""
WITH e AS (SELECT DISTINCT candidate_id, start_date, end_date, is_current, duration_months FROM v_experiences),
m AS (SELECT candidate_id, count(DISTINCT month) AS n FROM (SELECT candidate_id, unnest(generate_series(year(start_date) * 12 + month(start_date), year(z) * 12 + month(z))) AS month FROM (SELECT *, CASE WHEN is_current THEN DATE '{TODAY}' ELSE end_date END AS z FROM e) WHERE start_date IS NOT NULL AND z IS NOT NULL) GROUP BY 1),
f AS (SELECT candidate_id, sum(duration_months) AS n FROM e WHERE start_date IS NULL GROUP BY 1)
SELECT candidate_id, CAST(coalesce(m.n, 0) + coalesce(f.n, 0) AS BIGINT) AS total_months FROM (SELECT DISTINCT candidate_id FROM e) LEFT JOIN m USING (candidate_id) LEFT JOIN f USING (candidate_id)
""")
def experience_months(spark: SparkSession, d: str) -> DataFrame:
    """E8."""
    return E.total_months(view(spark, d, "v_experiences"), TODAY)


@query("SELECT candidate_id, first(title ORDER BY start_date DESC, sort_order) AS current_title, first('c' || sort_order ORDER BY start_date DESC, sort_order) AS current_company FROM v_experiences WHERE is_current GROUP BY 1")
def current_positions(spark: SparkSession, d: str) -> DataFrame:
    """E10."""
    e = view(spark, d, "v_experiences").withColumns({"position_title_raw": F.col("title"), "company_name": F.concat(F.lit("c"), F.col("sort_order").cast("string"))})
    return E.current_position(e)


@query("SELECT candidate_id, raw_name AS normalized_name, count(*) AS n, max(least(confidence, CASE source WHEN 'inferred' THEN 0.5 WHEN 'about_text' THEN 0.7 ELSE 1.0 END)) AS confidence FROM v_profile_skills GROUP BY 1, 2")
def skill_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Capped by source."""
    return E.skills(view(spark, d, "v_profile_skills").withColumn("category", F.lit(None).cast("string"))).groupBy("candidate_id", "normalized_name").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


@query("SELECT candidate_id, section, count(*) FILTER (NOT o) AS create_count, count(*) FILTER (o AND n) AS update_count, count(*) FILTER (o AND n) AS unchanged_count, count(*) FILTER (NOT n) AS delete_count FROM (SELECT coalesce(a.candidate_id, b.candidate_id) AS candidate_id, 'skills' AS section, a.candidate_id IS NOT NULL AS o, b.candidate_id IS NOT NULL AS n FROM (SELECT DISTINCT candidate_id, value FROM v_skills) a FULL JOIN (SELECT DISTINCT candidate_id, title AS value FROM v_titles) b ON a.candidate_id = b.candidate_id AND a.value = b.value) GROUP BY 1, 2")
def collection_diff(spark: SparkSession, d: str) -> DataFrame:
    """Skills as stored keys, titles as incoming ones."""
    old = view(spark, d, "v_skills").select("candidate_id", F.lit("skills").alias("section"), F.col("value").alias("key"))
    return E.collection_diff(old, view(spark, d, "v_titles").select("candidate_id", F.lit("skills").alias("section"), F.col("title").alias("key")), replace=True)


@query("SELECT candidate_id, 'city' AS field, CASE WHEN candidate_id % 2 = 0 THEN city END AS old, country AS new, CASE WHEN candidate_id % 2 = 0 THEN 'keep' ELSE 'fill' END AS action FROM v_candidates")
def identity_diff(spark: SparkSession, d: str) -> DataFrame:
    """A payload gives every city; half are empty."""
    c = view(spark, d, "v_candidates")
    return E.identity_diff(c.select("candidate_id", F.when(F.col("candidate_id") % 2 == 0, F.col("city")).alias("city")), c.select("candidate_id", F.col("country").alias("city")), ["city"])


@query("SELECT candidate_id, (SELECT string_agg(value, ',' ORDER BY value) FROM v_skills s WHERE s.candidate_id = c.candidate_id) AS skills, (SELECT string_agg(title, ',' ORDER BY title) FROM v_titles t WHERE t.candidate_id = c.candidate_id) AS titles FROM v_candidates c")
def profile_assembly(spark: SparkSession, d: str) -> DataFrame:
    """E18."""
    p = E.profiles(view(spark, d, "v_candidates").select("candidate_id"), {"skills": (view(spark, d, "v_skills").select("candidate_id", "value"), ["value"]), "titles": (view(spark, d, "v_titles"), ["title"])})
    return p.select("candidate_id", *(F.nullif(F.array_join(f"{c}.{f}", ","), F.lit("")).alias(c) for c, f in (("skills", "value"), ("titles", "title"))))


@query("SELECT doc_id, w.phrase, w.value FROM documents d JOIN (VALUES ('licensed', 'license'), ('the', 'article'), ('der', 'article'), ('mit license', 'license')) AS w(phrase, value) ON regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || w.phrase || '($|[^\\p{L}\\p{N}_])')")
def dictionary_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Which phrases of a dictionary each document has."""
    docs = view(spark, d, "documents").select("doc_id", F.lower("text").alias("key"))
    return extraction.phrase_hits(docs, ["doc_id"], {"word": {"licensed": "license", "the": "article", "der": "article", "mit license": "license"}}).select("doc_id", "phrase", "value").distinct()


@query("SELECT doc_id, count(*) AS lines, sum(length(x)) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY doc_id")
def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of texts without headings."""
    rows = extraction.lines(view(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("description_clean")))
    return rows.groupBy(F.col("job_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS t, len(list_distinct(string_split(trim(regexp_replace(text, '[\\s]+', ' ', 'g')), ' '))) AS words FROM documents")
def collapsed_texts(spark: SparkSession, d: str) -> DataFrame:
    """White space collapsed, distinct words."""
    return view(spark, d, "documents").select("doc_id", X.collapse(F.col("text")).alias("t")).withColumn("words", F.size(F.array_distinct(F.split("t", " "))))


@query(r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare, regexp_extract(url, '^https?://([^/?#]+)', 1) AS domain FROM pages")
def page_domains(spark: SparkSession, d: str) -> DataFrame:
    """T11, T14."""
    return view(spark, d, "pages").select("page_id", without_query(F.col("url")).alias("bare"), canonical_url(F.col("url"))["domain"].alias("domain"))


@query(r"""SELECT page_id, regexp_extract(b, '^([^?]*?)/*(\?|$)', 1) || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical FROM (SELECT page_id, b, array_to_string(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'trk', 'trackingid', 'ref', 'refid', 'sessionid', 'lipi', 'midtoken')), '&') AS q FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages))""")
def page_canonical(spark: SparkSession, d: str) -> DataFrame:
    """pages' URLs without tracking and fragments."""
    return view(spark, d, "pages").select("page_id", canonical_url(F.col("url"))["url"].alias("canonical"))


@query("SELECT page_id, n AS rank, url FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s+(?:[^>]*?\\s)?href=\"([^\"]*)\"', 1)) AS url, unnest(generate_series(1, len(regexp_extract_all(html, '<a\\s+(?:[^>]*?\\s)?href=\"([^\"]*)\"', 1)))) AS n FROM pages)")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """S4, native."""
    return P.links(view(spark, d, "pages"))


@query()
def page_results(spark: SparkSession, d: str) -> DataFrame:
    """Result records of stored pages, and the pages that are rejected."""
    found, rejected = P.result_records(view(spark, d, "pages"))
    return found.unionByName(rejected, allowMissingColumns=True)


@query()
def page_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profile fields of stored pages."""
    return P.profile_fields(view(spark, d, "pages"))


# Result pages of every kind, and the records that they hold.
_RESULT_PAGES = """
SELECT p_partkey AS page_id, CASE p_size % 4 WHEN 0 THEN '<div class="g"><a href="https://people.example.com/' || p_partkey || '">' || p_name || '</a><p>' || p_type || '</p></div><article><h2>x</h2></article><div data-result="1"><a href="/r" title="T ' || p_brand || '"></a></div>'
  WHEN 1 THEN '<p>see <a href="/u/' || p_partkey || '">' || p_name || '</a> now</p><p><a href="/z">ab</a></p>' WHEN 2 THEN '<script><a href="/s">' || p_name || '</a></script><div>none</div>' END AS html FROM part"""


@query("""
SELECT p_partkey AS page_id, 1 AS rank, 'https://people.example.com/' || p_partkey AS url, p_name AS title, p_type AS snippet, CAST(NULL AS STRING) AS reject_reason FROM part WHERE p_size % 4 = 0
UNION ALL SELECT p_partkey, 3, '/r', 'T ' || p_brand, NULL, NULL FROM part WHERE p_size % 4 = 0
UNION ALL SELECT p_partkey, 1, '/u/' || p_partkey, p_name, 'see  now', NULL FROM part WHERE p_size % 4 = 1
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, 'empty_page' FROM part WHERE p_size % 4 = 3""")
def result_pages(spark: SparkSession, d: str) -> DataFrame:
    """Records of pages with boxes, with links alone and without links, and the pages that are rejected."""
    found, rejected = P.result_records(sql(spark, d, _RESULT_PAGES))
    return found.unionByName(rejected, allowMissingColumns=True)


# Profile pages; every part that may be missing is missing from some.
_PROFILES = """
SELECT p_partkey AS page_id, '<main><h1>' || p_name || '</h1>' || CASE WHEN p_size % 2 = 0 THEN '<div class="headline">Engineer at ' || p_brand || '</div>' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '<i aria-label="Status: Open to Work"></i>' ELSE '' END || '</main>'
  || CASE WHEN p_size % 5 = 0 THEN '<section class="about"><div class="description">' || p_type || ' <b>work</b></div></section>' ELSE '' END
  || '<section data-section="experience"><ul><li data-external-key="' || CASE WHEN p_size % 4 = 0 THEN 'k' || p_partkey ELSE '' END || '" data-skills="Python"><h3>' || p_type || '</h3><p class="company"><a href="' || CASE WHEN p_size % 3 = 0 THEN 'javascript:x' ELSE 'https://x.example.com/' || p_partkey END || '">' || p_brand || '</a></p><time>Mar ' || (2000 + p_size % 20) || ' - '
  || CASE WHEN p_size % 2 = 0 THEN 'Present' ELSE 'June ' || (2010 + p_size % 5) END || '</time></li><li><p>no name</p></li></ul></section>'
  || CASE WHEN p_size % 7 = 0 THEN '' ELSE '<div id="education"><div class="education-item"><h4>Uni ' || p_brand || '</h4><p class="degree">BSc' || CASE WHEN p_size % 2 = 0 THEN ', ' || p_type ELSE '' END || '</p><time>' || (1990 + p_size % 9) || ' - ' || (1994 + p_size % 9) || '</time></div></div>' END
  || '<ol class="skills-list"><li><h4>Python</h4><span>' || p_size || ' endorsements</span></li><li><h4>PYTHON</h4></li><li><h3>' || p_name || '</h3></li></ol><ul id="certifications"><li><h3>ISO ' || p_size || '</h3><span class="issue-date">Ocak 2015</span><a href="https://c.example.com/' || p_partkey || '">see</a></li></ul>'
  || '<ul id="languages"><li><h3>English</h3><span class="proficiency">Fluent</span></li><li><h3>ingilizce</h3></li><li><p>?</p></li></ul>' AS html FROM part"""
_START = "make_date(2000 + p_size % 20, 3, 1)"
_END = "CASE WHEN p_size % 2 = 1 THEN make_date(2010 + p_size % 5, 6, 1) END"


@query(f"""SELECT CAST(p_partkey AS STRING) AS page_id, p_name AS full_name, CASE WHEN p_size % 2 = 0 THEN 'Engineer at ' || p_brand END AS headline, CASE WHEN p_size % 5 = 0 THEN p_type || ' work' END AS about, p_size % 3 = 0 AS open_to_work,
  concat_ws(',', CASE WHEN p_size % 5 <> 0 THEN 'about_missing' END, CASE WHEN p_size % 2 = 1 THEN 'headline_missing' END, 'location_raw_missing', CASE WHEN p_size % 7 = 0 THEN 'education_missing' END, 'item_parse_failed', CASE WHEN {_END} < {_START} THEN 'invalid_date_range' END) AS warnings FROM part""")
def profile_identities(spark: SparkSession, d: str) -> DataFrame:
    """Who profile pages are about, and what of them is missing."""
    return P.profile_fields(sql(spark, d, _PROFILES, dealt="part")).select("page_id", "full_name", "headline", "about", "open_to_work", F.array_join("warnings", ",").alias("warnings"))


@query(f"""SELECT CAST(p_partkey AS STRING) AS page_id, p_type AS position_title_raw, CASE WHEN p_size % 4 = 0 THEN 'k' || p_partkey ELSE 'linkedin:' || left(sha256(p_type || '|' || p_brand || '|' || {_START} || '|' || coalesce(CAST({_END} AS STRING), 'None') || '|' || CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END), 24) END AS external_key,
  p_brand AS company_name, CASE WHEN p_size % 3 <> 0 THEN 'https://x.example.com/' || p_partkey END AS company_url, {_START} AS start_date, {_END} AS end_date, p_size % 2 = 0 AS is_current, 'Python' AS skills, 0 AS sort_order FROM part""")
def profile_experiences(spark: SparkSession, d: str) -> DataFrame:
    """Experiences of profile pages."""
    rows = P.profile_section(P.profile_fields(sql(spark, d, _PROFILES, dealt="part")), "experience")
    return rows.select("page_id", "position_title_raw", "external_key", "company_name", "company_url", "start_date", "end_date", "is_current", F.array_join("skills_detected", ",").alias("skills"), "sort_order")


@query("""
SELECT CAST(p_partkey AS STRING) AS page_id, 'education' AS section, 'Uni ' || p_brand AS name, 'BSc,' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END || ',' || (1990 + p_size % 9) || ',' || (1994 + p_size % 9) AS detail FROM part WHERE p_size % 7 <> 0
UNION ALL SELECT CAST(p_partkey AS STRING), 'skills', 'Python', CAST(p_size AS STRING) FROM part UNION ALL SELECT CAST(p_partkey AS STRING), 'skills', p_name, '' FROM part
UNION ALL SELECT CAST(p_partkey AS STRING), 'certifications', 'ISO ' || p_size, '2015-01-01,https://c.example.com/' || p_partkey FROM part UNION ALL SELECT CAST(p_partkey AS STRING), 'languages', 'English', 'Fluent' FROM part""")
def profile_details(spark: SparkSession, d: str) -> DataFrame:
    """The other sections of profile pages; of two names of one skill or language the first stays."""
    shown = {"education": ("institution_name", ("degree", "field_of_study", "start_year", "end_year")), "skills": ("raw_name", ("endorsement_count",)), "certifications": ("name", ("issue_date", "credential_url")), "languages": ("language", ("proficiency",))}
    text = lambda x, cols: F.concat_ws(",", *(F.coalesce(x[c].cast("string"), F.lit("")) for c in cols))
    item = lambda s, name, cols: F.transform(s, lambda x: F.struct(F.lit(s).alias("section"), x[name].alias("name"), text(x, cols).alias("detail")))
    pages = P.profile_fields(sql(spark, d, _PROFILES, dealt="part"))
    return pages.select("page_id", F.explode(F.concat(*(item(s, *v) for s, v in shown.items()))).alias("x")).select("page_id", "x.*")


_HEAD = "SELECT p_partkey AS k, p_name || CASE WHEN p_size % 3 = 0 THEN ' at ' || p_brand WHEN p_size % 3 = 1 THEN ' | ' || p_brand ELSE '' END AS h FROM part"


@query(f"SELECT k, CASE WHEN h LIKE '% at %' THEN split_part(h, ' at ', 1) WHEN h LIKE '%|%' THEN trim(split_part(h, '|', 1)) END AS title, CASE WHEN h LIKE '% at %' THEN split_part(h, ' at ', 2) END AS company, CASE WHEN h LIKE '% at %' THEN 0.95 WHEN h LIKE '%|%' THEN 0.7 ELSE 0.3 END AS confidence FROM ({_HEAD})")
def headlines(spark: SparkSession, d: str) -> DataFrame:
    """T8."""
    return sql(spark, d, _HEAD).select("k", X.headline_parts(F.col("h")).alias("x")).select("k", "x.title", "x.company", "x.confidence")


_EXP = "SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN 'at least ' || (p_size % 9) || ' years' WHEN p_size % 4 = 1 THEN (p_size % 5) || '-' || (p_size % 5 + p_size % 3) || ' years of work' WHEN p_size % 4 = 2 THEN (p_size % 30) || ' months' ELSE p_name END AS t, p_size AS s FROM part"


@query(f"SELECT k, CASE s % 4 WHEN 0 THEN CAST(s % 9 AS DOUBLE) WHEN 1 THEN s % 5 WHEN 2 THEN (s % 30) / 12 END AS lo, CASE s % 4 WHEN 1 THEN CAST(s % 5 + s % 3 AS DOUBLE) END AS hi FROM ({_EXP})")
def experience_phrases(spark: SparkSession, d: str) -> DataFrame:
    """X8."""
    return sql(spark, d, _EXP).select("k", extraction.experience_of(F.col("t")).alias("e")).select("k", "e.lo", "e.hi")


_POSTING = """
SELECT CAST(p_partkey AS STRING) AS job_id, CASE WHEN p_size % 2 = 0 THEN 'Software Developer' ELSE p_name END AS title, p_size, p_name || chr(10) || 'Requirements:' || chr(10) || '- Minimum ' || (p_size % 9 + 1) || ' years' || chr(10)
       || '- ' || CASE WHEN p_size % 3 = 0 THEN 'Python and SQL Server' ELSE 'Docker' END || chr(10) || '- ' || CASE WHEN p_size % 4 = 0 THEN 'Masters degree in Mechanical Engineering or a related field' ELSE 'High school diploma' END || chr(10)
       || 'Nice to have:' || chr(10) || '- Kubernetes. Fluent English.' || chr(10) || '- ' || CASE WHEN p_size % 5 = 0 THEN 'ISO9001 in heavy industry' ELSE 'Bonus points for steel' END || chr(10) || 'Location:' || chr(10) || 'Bursa / remote' AS description_raw,
       CASE WHEN p_size % 7 = 0 THEN 'Narnia' END AS location_raw, 'Bursa' AS city, 'Turkey' AS country, CASE WHEN p_size % 10 = 0 THEN 'archived' ELSE 'draft' END AS status
FROM part"""
# What the posting above holds, as cases: condition, type, value, importance, confidence, the sentence it stands in (null: a column of the job).
_HELD = """
SELECT job_id, type, CASE WHEN type = 'title' THEN CASE WHEN p_size % 2 = 0 THEN 'software developer' ELSE lower(title) END WHEN type = 'experience' THEN 'min:' || (p_size % 9 + 1) ELSE value END AS normalized_value,
       importance, CASE importance WHEN 'required' THEN 1.0 WHEN 'preferred' THEN 0.6 ELSE 0.3 END AS weight, confidence, CASE WHEN type = 'title' THEN title WHEN type = 'experience' THEN 'Minimum ' || (p_size % 9 + 1) || ' years' ELSE sentence END AS evidence_text, NOT plain AS placed, description_raw
FROM p JOIN (VALUES
  (1, 0, 'title', '', 'required', 1.0, '', TRUE), (1, 0, 'experience', '', 'required', 0.95, '', FALSE),
  (3, 0, 'skill', 'python', 'required', 0.95, 'Python and SQL Server', FALSE), (3, 0, 'skill', 'sql server', 'required', 0.95, 'Python and SQL Server', FALSE), (3, NULL, 'skill', 'docker', 'required', 0.95, 'Docker', FALSE),
  (1, 0, 'skill', 'kubernetes', 'preferred', 0.95, 'Kubernetes.', FALSE), (1, 0, 'language', 'english:fluent', 'preferred', 0.95, 'Fluent English.', FALSE),
  (4, 0, 'education', 'field:mechanical engineering', 'required', 0.95, 'Masters degree in Mechanical Engineering or a related field', FALSE), (4, 0, 'education', 'level:master', 'required', 0.9, 'Masters degree in Mechanical Engineering or a related field', FALSE),
  (4, NULL, 'education', 'level:high_school', 'required', 0.9, 'High school diploma', FALSE),
  (4, 0, 'industry', 'engineering', 'required', 0.85, 'Masters degree in Mechanical Engineering or a related field', FALSE), (5, 0, 'certification', 'iso 9001', 'preferred', 0.9, 'ISO9001 in heavy industry', FALSE), (5, 0, 'industry', 'heavy industry', 'preferred', 0.85, 'ISO9001 in heavy industry', FALSE), (5, NULL, 'industry', 'steel', 'optional', 0.85, 'Bonus points for steel', FALSE),
  (1, 0, 'location', 'city:bursa', 'required', 1.0, 'Bursa', TRUE), (1, 0, 'location', 'country:turkey', 'required', 1.0, 'Turkey', TRUE), (7, 0, 'location', 'city:narnia', 'required', 0.95, 'Narnia', TRUE), (1, 0, 'location', 'work_mode:remote', 'optional', 0.9, 'Bursa / remote', FALSE)
) AS c(every, rest, type, value, importance, confidence, sentence, plain) ON CASE WHEN rest IS NULL THEN p_size % every <> 0 ELSE p_size % every = rest END
WHERE status = 'draft'"""


@query(f"""WITH p AS ({_POSTING}), h AS ({_HELD}) SELECT job_id, type, normalized_value, importance, CAST(weight AS DOUBLE) AS weight, CAST(confidence AS DOUBLE) AS confidence, evidence_text,
  CASE WHEN placed THEN CAST(strpos(description_raw, CASE WHEN evidence_text LIKE '%.' THEN evidence_text ELSE evidence_text || CASE WHEN evidence_text LIKE 'Bursa%' THEN '' ELSE chr(10) END END) - 1 AS INT) END AS evidence_start,
  CASE WHEN placed THEN CAST(strpos(description_raw, CASE WHEN evidence_text LIKE '%.' THEN evidence_text ELSE evidence_text || CASE WHEN evidence_text LIKE 'Bursa%' THEN '' ELSE chr(10) END END) - 1 + length(evidence_text) AS INT) END AS evidence_end FROM h""")
def posting_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Typed requirements of postings made of known parts, with the sentence and the place each stems from."""
    return extraction.parse(sql(spark, d, _POSTING, dealt="part"))[1].select("job_id", "type", "normalized_value", "importance", "weight", "confidence", "evidence_text", "evidence_start", "evidence_end")


@query(f"""SELECT job_id, CASE WHEN p_size % 3 = 0 THEN 'python,sql server' ELSE 'docker' END AS required_skills, 'kubernetes' AS preferred_skills, CASE WHEN p_size % 4 = 0 THEN 'mechanical engineering' ELSE '' END AS education_fields, CASE WHEN p_size % 4 = 0 THEN 'master' ELSE 'high_school' END AS education_levels,
  'city:bursa,country:turkey' || CASE WHEN p_size % 7 = 0 THEN ',city:narnia' ELSE '' END || ',work_mode:remote' AS locations, 'english:fluent' AS languages, CASE WHEN p_size % 5 = 0 THEN 'iso 9001' ELSE '' END AS certifications, CASE WHEN p_size % 4 = 0 THEN 'engineering,' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN 'heavy industry' ELSE 'steel' END AS industries,
  CAST(p_size % 9 + 1 AS DOUBLE) AS min_experience_years, CAST(NULL AS DOUBLE) AS max_experience_years, CASE WHEN p_size % 2 = 0 THEN 'software developer' ELSE lower(title) END AS title_candidates,
  (CASE WHEN p_size % 2 = 0 THEN 'software developer' ELSE lower(title) END) || k AS keywords_en, CASE WHEN p_size % 2 = 0 THEN 'yazılım geliştirici,yazılım geliştirme uzmanı' || k ELSE substr(k, 2) END AS keywords_tr,
  CASE WHEN p_size % 4 = 0 THEN 'related_departments_phrase_detected' ELSE '' END AS warnings, 1.0 AS confidence, 'parsed' AS status
FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN ',python,sql server' ELSE ',docker' END || ',kubernetes' || CASE WHEN p_size % 4 = 0 THEN ',mechanical engineering' ELSE '' END || ',bursa,turkey' || CASE WHEN p_size % 7 = 0 THEN ',narnia' ELSE '' END || ',remote' || CASE WHEN p_size % 5 = 0 THEN ',iso 9001' ELSE '' END || CASE WHEN p_size % 4 = 0 THEN ',engineering' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ',heavy industry' ELSE ',steel' END AS k FROM ({_POSTING}) AS p) AS x WHERE status = 'draft'""")
def parsed_postings(spark: SparkSession, d: str) -> DataFrame:
    """What the requirements of a posting roll up to."""
    lists = ["required_skills", "preferred_skills", "education_fields", "education_levels", "locations", "languages", "certifications", "industries", "title_candidates", "keywords_en", "keywords_tr", "warnings"]
    return extraction.parse(sql(spark, d, _POSTING, dealt="part"))[0].select("job_id", *(F.array_join(c, ",").alias(c) for c in lists), "min_experience_years", "max_experience_years", "confidence", "status")


@query(f"SELECT job_id, 'status_not_parsable' AS reject_reason FROM ({_POSTING}) AS p WHERE status = 'archived'")
def rejected_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings that are not parsed."""
    return extraction.rejected(sql(spark, d, _POSTING, dealt="part"))


# Results of every kind that D1 tells apart, by the remainder of their id.
_FOUND = """
SELECT result_id, query_id AS job_id, result_id % 11 AS k, CASE result_id % 11 WHEN 0 THEN normalized_url WHEN 1 THEN 'https://www.linkedin.com/in/slug-' || (result_id % 900) WHEN 2 THEN 'https://www.linkedin.com/in/p' || (result_id % 300) WHEN 3 THEN 'https://linkedin.com/company/' || query_id
       WHEN 4 THEN 'https://linkedin.com/pulse/' || query_id WHEN 5 THEN 'https://github.com/u' || (result_id % 200) WHEN 6 THEN 'https://github.com/u' || (result_id % 200) || '/repo' WHEN 7 THEN 'https://google.com/search' WHEN 8 THEN NULL WHEN 9 THEN 'https://www.github.com/v' || (result_id % 200) ELSE 'https://blog.example.com/' || (result_id % 300) END AS normalized_url,
       CASE result_id % 11 WHEN 1 THEN 'Slug-' || (result_id % 900) WHEN 2 THEN 'p' || (result_id % 300) END AS candidate_profile_slug, CASE WHEN result_id % 11 IN (0, 1, 5) THEN 'Dr. Person ' || (result_id % 500) WHEN result_id % 11 = 2 THEN 'LinkedIn Member' END AS displayed_name,
       CASE WHEN result_id % 11 IN (0, 6) THEN 'Engineer at Acme' WHEN result_id % 11 = 1 THEN 'Engineer | Acme' END AS displayed_headline, CASE WHEN result_id % 2 = 0 THEN 'Bursa, Turkey' END AS displayed_location, CAST(NULL AS STRING) AS title, CAST(NULL AS STRING) AS snippet
FROM v_results"""


_DECIDED = f"""f AS ({_FOUND}),
e AS (SELECT f.*, reason, eligible, CAST(conf AS DOUBLE) AS confidence, source FROM f JOIN (VALUES (0, TRUE, 'personal_profile', 0.7, 'personal_profile_metadata'), (1, TRUE, 'linkedin_profile', 0.98, 'linkedin_profile_url'), (2, TRUE, 'linkedin_profile', 0.9, 'linkedin_profile_url'), (3, FALSE, 'unsupported', 0.0, 'non_person_linkedin_page'),
  (4, FALSE, 'unsupported', 0.0, 'non_profile_linkedin_url'), (5, TRUE, 'github_profile', 0.8, 'github_user_profile'), (6, TRUE, 'personal_profile', 0.7, 'personal_profile_metadata'), (7, FALSE, 'unsupported', 0.0, 'search_engine_result'), (8, FALSE, 'unsupported', 0.0, 'invalid_profile_url'), (9, FALSE, 'github_profile', 0.3, 'missing_person_metadata'), (10, FALSE, 'unsupported', 0.2, 'missing_person_metadata')) AS c(n, eligible, source, conf, reason) ON k = n)"""


@query(f"""
WITH {_DECIDED},
u AS (SELECT normalized_profile_url AS normalized_url, arg_min(candidate_id, (created_at, candidate_id)) AS by_url FROM v_people WHERE normalized_profile_url IS NOT NULL GROUP BY 1),
s AS (SELECT lower(profile_slug) AS slug, arg_min(candidate_id, (created_at, candidate_id)) AS by_slug FROM v_people WHERE profile_slug IS NOT NULL GROUP BY 1),
j AS (SELECT e.*, coalesce(by_url, by_slug) AS known, coalesce(lower(candidate_profile_slug), normalized_url) AS identity FROM e LEFT JOIN u USING (normalized_url) LEFT JOIN s ON s.slug = lower(candidate_profile_slug)),
l AS (SELECT *, CASE WHEN eligible AND known IS NULL THEN first_value(result_id) OVER (PARTITION BY identity, eligible, known IS NULL ORDER BY normalized_url, result_id) END AS leader_id FROM j)
SELECT result_id, CASE WHEN NOT eligible THEN 'skip' WHEN known IS NULL AND result_id = leader_id THEN 'create' ELSE 'link' END AS action, known AS candidate_id, leader_id, reason, confidence, source,
  CASE WHEN k IN (0, 1, 5) THEN 'Person ' || (result_id % 500) END AS full_name, displayed_headline AS headline, CASE WHEN k IN (0, 6) THEN 'Engineer' END AS current_title, CASE WHEN k IN (0, 6) THEN 'Acme' END AS current_company, CASE WHEN displayed_location IS NOT NULL THEN 'Turkey' END AS country FROM l
""")
def discovered_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Results to link, create or skip."""
    people = view(spark, d, "v_people").select("candidate_id", "normalized_profile_url", "profile_slug", "created_at")
    return imports.discover(sql(spark, d, _FOUND), people).select("result_id", "action", "candidate_id", "leader_id", "reason", "confidence", "source", "full_name", "headline", "current_title", "current_company", "country")
