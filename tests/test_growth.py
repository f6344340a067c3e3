"""What keeps time, memory and disk in step with the input."""

import re

from pyspark.sql import functions as F

from rolegraph.functions import text
from rolegraph.operators import enrichment, extraction, imports, matching
from rolegraph.plans import queries as Q
from rolegraph.plans import enriching, importing, records
from rolegraph.plans import views
from rolegraph.plans.views import sql


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_file_are_dealt_out(spark, sf):
    # A million short rows are one row group of one file.
    dealt = sql(spark, sf, "SELECT p_partkey FROM part", dealt="part")
    assert dealt.rdd.getNumPartitions() > sql(spark, sf, "SELECT p_partkey FROM part").rdd.getNumPartitions()
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, sql(spark, sf, "SELECT p_partkey FROM part").collect()))
    assert "Exchange RoundRobin" in plan(Q.profile_details(spark, sf))


def test_rejected_postings_parse_nothing(spark, sf):
    postings = sql(spark, sf, Q._POSTING)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(extraction.rejected(postings)) == rows(extraction.parse(postings)[2])


def test_evidence_does_not_pass_through_python(spark, sf):
    # Spark spills what goes past a Python function; long texts must have left by then.
    p = plan(records.result_texts(spark, sf))
    assert p.index("ArrowEvalPython") < p.index("Generate")


def test_long_evidence_is_judged_by_its_bytes(spark, sf):
    # Counting characters reads a whole text; rows of one file with texts that grow with the key go to all cores.
    p = plan(records.result_texts(spark, sf))
    assert "Exchange RoundRobin" in p and re.search(r"octet_length\(evidence#\d+\) <= 8000\) AND \(length\(evidence#\d+\) <= 2000", p)
    texts = [None, "", "a" * 2000, "a" * 2001, "é" * 2000, "é" * 2001, "😀" * 2000, "😀" * 2000 + "a", "a" * 9000, "😀 <HtML>", "<!DOCTYPE html>"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.evidence_ok(F.col("t"))).collect()
    assert [r[1] for r in sorted(got)] == [True, True, True, False, True, False, True, False, False, False, False]


def test_discovery_reads_texts_once(spark):
    rows = spark.createDataFrame([(1, 1, "https://www.linkedin.com/in/ada", "ada", "Ada", None, None, None, None)], "result_id long, job_id long, normalized_url string, candidate_profile_slug string, displayed_name string, displayed_headline string, displayed_location string, title string, snippet string")
    none = spark.createDataFrame([], "candidate_id long, normalized_profile_url string, profile_slug string, created_at timestamp")
    got = imports.discover(rows, none)
    assert "ArrowEvalPython" not in plan(got) and [r.action for r in got.select(F.col("action")).collect()] == ["create"]


def test_equal_token_sets_meet_once(spark):
    # 2,000 jobs ask for the same; the join on tokens must not see them all.
    left = spark.range(2000).select(F.col("id").alias("job_id"), F.expr("IF(id = 0, array('x'), array('a', 'b'))").alias("a"))
    right = spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["d"],)], "b array<string>")
    got = matching.overlaps(left.unionByName(left.filter("job_id = 1")), right)
    p = plan(got)
    assert {tuple(r)[1:] for r in got.filter("job_id > 1").collect()} == {(2, 1)}
    assert got.filter("job_id < 2").collect() == [(1, 4, 2)]
    aggregated = [line for line in p.splitlines() if "Generate explode(a" in line]
    assert aggregated and all("HashAggregate(keys=[a#" in p[p.index(line) : p.index(line) + 900] for line in aggregated)


def test_rules_read_joined_tables_once(spark, sf):
    # Nine rules of three tables read order lines; each table is joined once and read from where it is kept.
    p = plan(records.integrity_report(spark, sf))
    assert "lineitem.parquet" not in p and p.count("FileScan parquet") > 9


def test_evidence_of_a_pair_is_one_row(spark, sf):
    # Pairs meet jobs and candidates once; nothing is grouped by pair again.
    grouped = re.findall(r"Aggregate\(keys=\[(?:job_id#\d+L?, candidate_id#\d+L?|candidate_id#\d+L?, job_id#\d+L?)\], functions=\[([^\]]*)", plan(Q.match_explained(spark, sf)))
    assert grouped and not any(grouped)


def test_urls_of_an_import_are_made_once(spark, sf):
    got = importing.import_into_storage(spark, sf)
    got.collect()
    p = plan(got)
    final = p[: p.index("Initial Plan")] if "Initial Plan" in p else p
    # The canonical URL is made by a generator.
    assert len(re.findall(r"Generate explode\(array\(", final)) == 1


def test_imported_skills_lie_by_candidate(spark, sf, monkeypatch):
    # More order lines take more tasks, and the last of them sorts a candidate's rows once, however many tables meet there.
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(views, "LINES", lines // 6)
    tasks = views.parts(spark, sf)
    assert tasks == lines // (lines // 6) + 1 > spark.sparkContext.defaultParallelism
    p = plan(enriching.enriched_skills(spark, sf))
    dealt = re.findall(r"Exchange hashpartitioning\(([^#]+)#[^,]*, (\d+)\), REPARTITION_BY_NUM", p)
    assert {k for k, _ in dealt} >= {"candidate_id", "l_orderkey", "p_partkey"} and {int(n) for _, n in dealt} == {tasks}
    assert len(re.findall(r"Sort \[candidate_id#[^,]*, key#", p)) == 1 and p.count("+- Window [") == 1


def test_fate_of_rows(spark):
    # What the steps one by one give: the last of a key, the stored rows without it, and those that replace modes leave.
    frame = lambda rows: spark.createDataFrame(rows, "candidate_id long, key string, pos long, v int")
    old = frame([(1, "a", 1, 1), (1, "a", 2, 2), (1, "b", 3, 3), (2, "a", 1, 4), (2, "b", 2, 5), (3, "a", 1, 6), (4, None, 1, 7), (None, "a", 1, 8)])
    new = frame([(1, "a", 5, 11), (1, "a", 6, 12), (1, "c", 7, 13), (2, "b", 1, 14), (3, "a", 1, 15), (4, None, 1, 16), (None, "a", 2, 17)])
    payloads = spark.createDataFrame([(1, "merge", []), (2, "replace_all", []), (4, "replace_sections", ["language"])], "candidate_id long, import_mode string, sections_present array<string>")
    got = enrichment.settled(old, new, payloads, "skill", 3)
    fates = {(r.v, r.fate) for r in got.collect()}
    assert fates == {(1, "update"), (2, "update"), (3, "keep"), (12, "overwrite"), (13, "create"), (4, "delete"), (5, "update"), (14, "overwrite"), (6, "keep"), (7, "keep"), (16, "create"), (8, "keep")}
    good = enrichment.last_of_key(new.join(payloads.select("candidate_id"), "candidate_id", "left_semi"), ["candidate_id", "key"])
    want = enrichment.upserted(old, good, payloads, ["candidate_id", "key"], "skill")
    rows = lambda df: sorted(map(str, df.select("candidate_id", "key", "pos", "v").collect()))
    assert rows(got.filter("fate in ('keep', 'create', 'overwrite')")) == rows(want)
