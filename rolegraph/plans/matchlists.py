"""Registered query of list scores over education, language, certification and industry values (M8), with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.operators import matching
from rolegraph.plans.queries import query
from rolegraph.plans.views import view

_ASKED = {"education": "p_type", "language": "p_brand", "certification": "p_name", "industry": "p_name || ' ' || p_type || ' group'"}
_HELD = {"education": "array_to_string(list_reverse(string_split(v, ' ')), ' ')", "language": "array_to_string(list_reverse(string_split(v, ' ')), ' ')", "certification": "array_to_string(string_split(v, ' ')[1:4], ' ')", "industry": "v || ' ltd'"}


@query(f"""
WITH req AS ({' UNION ALL '.join(f"SELECT p_partkey AS job_id, '{c}' AS category, lower({v}) AS v FROM part" for c, v in _ASKED.items())}),
val AS (SELECT DISTINCT candidate_id, category, list_distinct(string_split(v, ' ')) AS t FROM ({' UNION ALL '.join(f"SELECT job_id % 40 AS candidate_id, category, {h} AS v FROM req WHERE category = '{c}' AND job_id % 3 = 0" for c, h in _HELD.items())})),
pair AS (SELECT p_partkey AS job_id, p_partkey % 40 AS candidate_id FROM part UNION ALL SELECT p_partkey, (p_partkey + 1) % 40 FROM part),
hit AS (SELECT job_id, candidate_id, category, EXISTS (SELECT 1 FROM val WHERE val.candidate_id = pr.candidate_id AND val.category = pr.category AND 100.0 * len(list_intersect(val.t, pr.t)) / (len(val.t) + len(pr.t) - len(list_intersect(val.t, pr.t))) >= 80) AS found
  FROM (SELECT job_id, candidate_id, category, list_distinct(string_split(v, ' ')) AS t FROM pair JOIN req USING (job_id)) pr)
SELECT job_id, candidate_id, category, 100.0 * count(CASE WHEN found THEN 1 END) / count(*) AS score FROM hit GROUP BY ALL""")
def match_lists(spark: SparkSession, d: str) -> DataFrame:
    """M3, M8: list scores; candidates hold reversed, shortened and longer forms of what every third job asks."""
    part = view(spark, d, "part").selectExpr("p_partkey AS job_id", "map('education', p_type, 'language', p_brand, 'certification', p_name, 'industry', p_name || ' ' || p_type || ' group') AS asked")
    req = part.select("job_id", F.explode("asked").alias("category", "value")).withColumn("req_id", F.concat_ws("/", "job_id", "category"))
    words = F.split("value", " ")
    held = F.when(F.col("category").isin("education", "language"), F.array_join(F.reverse(words), " ")).when(F.col("category") == "certification", F.array_join(F.slice(words, 1, 4), " ")).otherwise(F.concat("value", F.lit(" ltd")))
    values = req.filter("job_id % 3 = 0").select((F.col("job_id") % 40).alias("candidate_id"), "category", held.alias("value"))
    pairs = part.select("job_id", F.explode(F.array(F.col("job_id") % 40, (F.col("job_id") + 1) % 40)).alias("candidate_id"))
    hits = matching.requirement_hits(pairs, req, values)
    return hits.groupBy("job_id", "candidate_id", "category").agg((100.0 * F.count_if("found") / F.count(F.lit(1))).alias("score"))
