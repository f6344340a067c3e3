"""Registered queries of merges whose plans overlap (R7-R9, R15-R17), with DuckDB SQL.

Of each ten customers one to nine are named by six plans in order: 1 takes 2 and 3; 4 wants 2, which is gone; 5 takes
1 with all that it got; 1, by now gone, wants 6; 5 takes 7; 8 wants itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.operators import candidates as C
from rolegraph.plans.queries import query
from rolegraph.plans.views import sql

_PEOPLE = "SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS full_name, CASE WHEN c_custkey % 4 = 0 THEN 'CITY_' || c_nationkey WHEN c_custkey % 4 = 1 THEN ' ' END AS city, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 200 END AS total_experience_months FROM customer"
_PLAN = "SELECT g * 10 + n AS cluster_id, n AS plan_ord, g * 10 + t AS target_id, g * 10 + s AS source_id, o AS source_ord, CASE WHEN n = 5 THEN 'prefer_newest' ELSE 'keep_target' END AS strategy FROM (SELECT c_custkey DIV 10 AS g FROM customer WHERE c_custkey % 10 = 9) CROSS JOIN (VALUES (1, 1, 2, 1), (1, 1, 3, 2), (2, 4, 2, 1), (3, 5, 1, 1), (4, 1, 6, 1), (5, 5, 7, 1), (6, 8, 8, 1)) AS p(n, t, s, o)"
_OWN = f"c AS (SELECT *, candidate_id // 10 AS g, candidate_id % 10 AS k FROM ({_PEOPLE})), f AS (SELECT g FROM c WHERE k = 9), w AS (SELECT g, k, full_name, nullif(trim(city), '') AS city, total_experience_months AS months FROM c JOIN f USING (g))"
_FIVE = "SELECT g, " + ", ".join(f"first({f} ORDER BY list_position([5, 1, 2, 3, 7], k)) FILTER ({f} IS NOT NULL) AS {f}" for f in ("full_name", "city", "months")) + " FROM w WHERE k IN (5, 1, 2, 3, 7) GROUP BY g"


def _merge(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    people = sql(spark, d, _PEOPLE).withColumn("updated_at", F.to_timestamp(F.lit("2020-01-01")))
    return C.merge(people, sql(spark, d, _PLAN), {"search_results": sql(spark, d, "SELECT o_custkey AS candidate_id, o_orderkey AS result_id FROM orders")})


@query(f"""
WITH {_OWN}, m AS ({_FIVE}), o AS (SELECT CASE WHEN f.g IS NOT NULL AND o_custkey % 10 IN (1, 2, 3, 7) THEN o_custkey // 10 * 10 + 5 ELSE o_custkey END AS candidate_id, count(*) AS results FROM orders LEFT JOIN f ON f.g = o_custkey // 10 GROUP BY 1)
SELECT c.candidate_id, CASE WHEN k = 5 THEN coalesce(m.full_name, c.full_name) ELSE c.full_name END AS full_name, CASE WHEN k = 5 AND m.g IS NOT NULL THEN m.city ELSE c.city END AS city, CASE WHEN k = 5 AND m.g IS NOT NULL THEN m.months ELSE c.total_experience_months END AS months, coalesce(results, 0) AS results
FROM c LEFT JOIN m USING (g) LEFT JOIN o USING (candidate_id) WHERE NOT (k IN (1, 2, 3, 7) AND m.g IS NOT NULL)""")
def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates after plans that overlap, with how many search results each has."""
    people, children, _ = _merge(spark, d)
    n = children["search_results"].groupBy("candidate_id").agg(F.count(F.lit(1)).alias("results"))
    return people.join(n, "candidate_id", "left").select("candidate_id", "full_name", "city", F.col("total_experience_months").alias("months"), F.coalesce("results", F.lit(0)).alias("results"))


def _conflicts(members: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN len(list_distinct(list_filter([{members.replace('@', f)}], lambda x: x IS NOT NULL))) > 1 THEN '{name}' END" for f, name in (("full_name", "full_name"), ("city", "city"), ("months", "total_experience_months"))) + ")"


_SIDE = "".join(f", any_value({f}) FILTER (k = {k}) AS {f}{k}" for f in ("full_name", "city", "months") for k in (1, 2, 3, 5, 7))


@query(f"""
WITH {_OWN}, x AS (SELECT g{_SIDE} FROM w GROUP BY g), n AS (SELECT o_custkey // 10 AS g, o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY ALL), moved AS (SELECT g, coalesce(sum(n) FILTER (k IN (2, 3)), 0) AS n1, coalesce(sum(n) FILTER (k IN (1, 2, 3)), 0) AS n3, coalesce(sum(n) FILTER (k = 7), 0) AS n5 FROM f LEFT JOIN n USING (g) GROUP BY g)
SELECT g * 10 + 1 AS cluster_id, g * 10 + 1 AS target_id, {_conflicts('@1, @2, @3')} AS conflicts, CAST(n1 AS BIGINT) AS moved FROM x JOIN moved USING (g)
UNION ALL SELECT g * 10 + 3, g * 10 + 5, {_conflicts('@5, coalesce(@1, @2, @3)')}, CAST(n3 AS BIGINT) FROM x JOIN moved USING (g)
UNION ALL SELECT g * 10 + 5, g * 10 + 5, {_conflicts('coalesce(@5, @1, @2, @3), @7')}, CAST(n5 AS BIGINT) FROM x JOIN moved USING (g)""")
def merge_audit(spark: SparkSession, d: str) -> DataFrame:
    """What each plan that held found in conflict and moved."""
    return _merge(spark, d)[2].select("cluster_id", "target_id", F.array_join("conflicts", ",").alias("conflicts"), F.col("moved_search_results").alias("moved"))


@query("SELECT c_custkey // 10 * 10 + n AS cluster_id, error FROM customer, (VALUES (2, 'candidate_missing'), (4, 'candidate_missing'), (6, 'target_is_source')) AS e(n, error) WHERE c_custkey % 10 = 9")
def merge_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Plans that are wrong, or name a candidate that an earlier one has taken."""
    return C.resolved(sql(spark, d, _PLAN), sql(spark, d, _PEOPLE))[1].select("cluster_id", F.explode("errors").alias("error"))
