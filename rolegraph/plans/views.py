"""The domain's tables derived from the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()
VIEWS = {
    "v_jobs": """
        SELECT p_partkey AS job_id, p_name AS title, p_brand AS company, p_type AS source, p_size % 12 AS min_years, 'CITY_' || (p_partkey % 25) AS city, r_name AS country,
               CASE WHEN p_size % 4 = 0 THEN 'draft' WHEN p_size % 4 = 1 THEN 'sourcing' WHEN p_size % 4 = 2 THEN 'parsed' ELSE 'completed' END AS status,
               CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'https://jobs.example.com/' || p_type || '/' || (p_partkey % 40) END AS source_url, p_name || ' for ' || p_type AS description, p_retailprice AS salary
        FROM part JOIN region ON r_regionkey = p_size % 5""",
    "v_requirements": """
        SELECT p_partkey AS job_id, p_partkey * 10 AS req_id, 'skill' AS category, p_name AS value, p_name AS raw_value, CASE WHEN p_size % 3 = 0 THEN 'required' ELSE 'preferred' END AS importance, 0 AS seq FROM part
        UNION ALL
        SELECT p_partkey, p_partkey * 10 + 1, 'skill', split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1), p_name, 'required', 1 FROM part WHERE p_size % 2 = 0
        UNION ALL
        SELECT p_partkey, p_partkey * 10 + 2, 'skill', split_part(p_name, ' ', 1) || ' widget', p_name, 'optional', 2 FROM part WHERE p_size % 5 = 0""",
    "v_candidates": """
        SELECT c_custkey AS candidate_id, c_name AS full_name, 'CITY_' || c_nationkey AS city, r_name AS country, c_mktsegment AS source, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 200 END AS total_experience_months, c_acctbal AS quality,
               CASE WHEN c_custkey % 3 = 0 THEN 'partial' ELSE 'scraped' END AS profile_status
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "v_skills": """
        SELECT DISTINCT o_custkey AS candidate_id, 'skill' AS category, p_name AS value
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""",
    "v_titles": """
        SELECT o_custkey AS candidate_id, p_name AS title
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_custkey, p_name HAVING count(*) > 2""",
    "v_queries": "SELECT p_partkey AS query_id, p_partkey AS job_id, p_name || ' ' || p_type AS query_text, p_brand AS owner, p_size AS created_at FROM part",
    "v_results": """
        SELECT l_orderkey * 10 + l_linenumber AS result_id, l_partkey AS query_id, CASE WHEN l_linestatus = 'O' THEN NULL ELSE o_custkey END AS candidate_id, 'https://people.example.com/' || (l_suppkey % 50) || '/' || (l_orderkey % 400) AS normalized_url, l_shipdate AS discovered_at
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "v_experiences": """
        SELECT o_custkey AS candidate_id, CAST(o_orderdate AS DATE) AS start_date, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(last_ship AS DATE) END AS end_date, o_orderstatus = 'O' AS is_current, CAST(NULL AS INT) AS duration_months, o_orderkey AS sort_order, o_orderpriority AS title
        FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey WHERE last_ship >= o_orderdate
        UNION ALL
        SELECT c_custkey, NULL, NULL, FALSE, c_custkey % 30, 0, c_mktsegment FROM customer WHERE c_custkey % 4 = 0""",
    "v_people": """
        SELECT o_orderkey AS candidate_id, o_orderdate AS created_at, 'person ' || (o_orderkey % 3000) AS full_name, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'https://people.example.com/' || (o_custkey % 700) || '/' || (o_orderkey % 40) END AS normalized_profile_url, CASE WHEN o_orderkey % 3 = 0 THEN 'slug-' || (o_custkey % 900) END AS profile_slug,
               o_orderpriority AS headline, 'CITY_' || (o_custkey % 10) AS city, o_orderstatus AS current_company
        FROM orders""",
    "v_members": """
        SELECT o_custkey AS cluster_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS ord, CASE WHEN o_custkey % 2 = 0 THEN 'prefer_newest' ELSE 'keep_target' END AS strategy, o_orderdate AS updated_at, o_orderkey AS candidate_id,
               CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'name ' || (o_orderkey % 5) END AS full_name, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS headline, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'CITY_' || (o_orderkey % 3) END AS city
        FROM orders""",
    "v_shortlist": """
        SELECT o_orderkey % 50 AS job_id, o_custkey AS candidate_id, min(CASE o_orderstatus WHEN 'O' THEN 'shortlisted' WHEN 'F' THEN 'reviewed' ELSE 'contacted' END) AS status, min(o_orderpriority) AS note, min(o_orderdate) AS created_at
        FROM orders GROUP BY o_orderkey % 50, o_custkey""",
    "v_matches": "SELECT o_orderkey % 50 AS job_id, o_custkey AS candidate_id, max(o_totalprice) / 10000 AS total_score FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_orderkey % 50, o_custkey",
    "v_profile_skills": """
        SELECT o_custkey AS candidate_id, p_name AS raw_name, CASE WHEN l_returnflag = 'R' THEN 'inferred' WHEN l_returnflag = 'A' THEN 'about_text' ELSE 'profile_skill' END AS source, 1 - l_discount AS confidence, CASE WHEN l_linenumber > 3 THEN CAST(l_quantity AS INT) END AS endorsement_count
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""",
}


#: Order lines whose rows one task takes where they are sorted and grouped.
LINES = 250_000


def parts(spark: SparkSession, sf_dir: str) -> int:
    """As many tasks as the order lines need, counted from the file's footers; at least one a core."""
    return max(spark.sparkContext.defaultParallelism, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // LINES + 1)


def sql(spark: SparkSession, sf_dir: str, body: str, dealt: str | None = None, keyed: Mapping[str, str] | None = None, tasks: int = 0) -> DataFrame:
    """The rows of a query over the driver's tables and the views above; only what it names is read, and no session-wide name is set.

    dealt: a table whose rows are dealt out over all cores as they are read. Work that takes long for each row needs
    that, since a file is cut by its bytes and row groups, and a million short rows are one task otherwise.
    keyed: tables and views with the column by which their rows go to so many tasks. What joins or groups them by that
    column goes there too, so with the tasks of parts() a task's share does not grow with the tables.
    """
    keyed = keyed or {}
    by = lambda t, rows: f"SELECT /*+ REPARTITION({tasks}, {keyed[t]}) */ * FROM {rows}" if t in keyed else ""
    named = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(VIEWS) + r")\b(?:\s+AS)?")
    while named.search(body):
        body = named.sub(lambda m: f"{m[1]} ({by(m[2], f'({VIEWS[m[2]]})') or VIEWS[m[2]]}) AS {m[2]}", body)
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = lambda t: f"parquet.`{sf_dir}/{t}.parquet`"
    read = lambda t: f"(SELECT /*+ REPARTITION({n}) */ * FROM {path(t)})" if t == dealt else f"({by(t, path(t))})" if t in keyed else path(t)
    return spark.sql(re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b", lambda m: f"{m[1]} {read(m[2])} AS {m[2]}", body))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, VIEWS[name]) if name in VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(body: str) -> str:
    """A query's SQL with the views that it names in front."""
    used = [n for n in VIEWS if n in body]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = body.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
