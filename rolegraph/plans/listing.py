"""Registered queries of deep pages, run listings and imports of other formats (L7, E17, S2, S3), with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.operators import enrichment
from rolegraph.operators import relational as R
from rolegraph.plans.queries import query
from rolegraph.plans.views import sql, view
from rolegraph.sources import tables as S


@query("SELECT l_orderkey * 10 + l_linenumber AS line_id, l_suppkey FROM lineitem ORDER BY l_suppkey DESC NULLS FIRST, line_id LIMIT 20 OFFSET 3980")
def deep_page(spark: SparkSession, d: str) -> DataFrame:
    """The two hundredth page of all lines, by a column of few values."""
    rows = view(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), "l_suppkey")
    return R.Ordered(rows, "l_suppkey", "line_id", ["l_suppkey"], descending=True).page(200)


_RUNS = "SELECT o_orderkey AS run_id, o_custkey AS candidate_id, CASE WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'browser' END AS provider, CASE WHEN o_orderkey % 2 = 0 THEN 'deep' ELSE 'basic' END AS mode, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'partial' END AS status, o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS completed_at FROM orders"


@query(f"SELECT candidate_id, run_id, status, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY completed_at DESC NULLS FIRST, run_id) AS rank, count(*) OVER (PARTITION BY candidate_id) AS total FROM ({_RUNS}) WHERE provider = 'browser' AND created_at >= '1994-01-01') WHERE rank BETWEEN 4 AND 6")
def enrichment_runs(spark: SparkSession, d: str) -> DataFrame:
    """The second page of three of each candidate's runs, with their number."""
    rows, meta = enrichment.runs_listed(sql(spark, d, _RUNS), provider="browser", since="1994-01-01", sort="completed_at", page=2, size=3)
    return rows.join(meta, "candidate_id").select("candidate_id", "run_id", "status", "rank", "total")


@query("""
SELECT 'json' AS format, o_custkey AS query_id, 'https://x.example/' || o_orderkey AS url, NULL AS reject_reason FROM orders WHERE o_custkey % 5 NOT IN (0, 4)
UNION ALL SELECT DISTINCT 'json', o_custkey, NULL, 'invalid_json' FROM orders WHERE o_custkey % 5 = 4
UNION ALL SELECT 'json', o_custkey, NULL, 'too_many_results' FROM orders WHERE o_custkey % 5 = 0 GROUP BY o_custkey HAVING count(*) > 12 UNION ALL SELECT 'json', o_custkey, 'https://x.example/' || o_orderkey, NULL FROM orders WHERE o_custkey % 5 = 0 AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) <= 12)
UNION ALL SELECT 'lines', o_custkey, NULL, 'too_many_results' FROM orders GROUP BY o_custkey HAVING count(*) > 12 UNION ALL SELECT 'lines', o_custkey, 'https://x.example/' || o_orderkey, NULL FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) <= 12)""")
def import_formats(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as an import in JSON and in lines; of the customers with more than 12 the import is too large (those with JSON: every fifth)."""
    orders = view(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("https://x.example/"), "o_orderkey").alias("url"))
    lists = orders.groupBy("query_id").agg(F.collect_list("url").alias("urls"))
    json = lists.select("query_id", F.when(F.col("query_id") % 5 == 4, F.lit("[{")).otherwise(F.to_json(F.transform("urls", lambda u: F.struct(u.alias("url"), F.lit(1).alias("rank"))))).alias("value"))
    parts = [("json", *S.json_results(json.filter("query_id % 5 <> 0"))), ("json", *S.json_results(json.filter("query_id % 5 = 0"), most=12)), ("lines", *S.url_records(lists.select("query_id", F.array_join("urls", "\n").alias("value")), most=12))]
    out = None
    for name, good, bad in parts:
        rows = good.select("query_id", "url").unionByName(bad, allowMissingColumns=True).withColumn("format", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("format", "query_id", "url", "reject_reason")
