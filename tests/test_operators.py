import datetime

import pytest
from pyspark.sql import functions as F

from rolegraph.operators import candidates as C
from rolegraph.operators import enrichment as E
from rolegraph.operators import extraction, imports, shortlists, sourcing
from rolegraph.operators import matching as M
from rolegraph.operators import relational as R
from rolegraph.sources import pages, tables

JOB = "job_id string, title string, description_raw string, location_raw string, city string, country string, status string"


@pytest.mark.parametrize(
    "text, want",
    [
        ("at least 2 years", (2.0, None, "min:2")),
        ("2-5 years", (2.0, 5.0, "range:2-5")),
        ("5+ years", (5.0, None, "min:5")),
        ("18 months", (1.5, None, "min:1.5")),
        ("Minimum 3 years", (3.0, None, "min:3")),
        ("3 to 7 years", (3.0, 7.0, "range:3-7")),
        ("New graduate", (0.0, 1.0, "range:0-1")),
        ("No experience required", (0.0, None, "min:0")),
        ("7-3 years", None),
        ("en az 2,5 yıl", (2.5, None, "min:2.5")),
    ],
)
def test_experience(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(extraction.experience_of(extraction.match_key(F.col("t"))).alias("e"))
    e = df.first().e
    assert (e and (e.lo, e.hi, e.label)) == want


def test_parse(spark):
    text = "Intro\nRequirements:\n- Python. At least 3 years.\n- python and SQL Server\nNice to have:\nDocker\nFluent English"
    jobs = [("a", "Yazılım Mühendisi", text, None, "Bursa", None, "draft"), ("b", "x", " \n", None, None, None, "draft"), ("c", "x", "y", None, None, None, "archived"), ("d", "Some title", "Come and join us.", None, None, None, "parsed")]
    parsed, found, rejected = extraction.parse(spark.createDataFrame(jobs, JOB))
    rows = {r.job_id: r for r in parsed.collect()}
    a = rows["a"]
    assert (a.required_skills, a.preferred_skills, a.min_experience_years, a.languages, a.locations) == (["python", "sql server"], ["docker"], 3.0, ["english:fluent"], ["city:bursa"])
    assert a.title_candidates == ["software engineer"] and a.keywords_tr[0] == "yazılım mühendisi"
    assert rows["d"].warnings == ["no_skills_detected", "no_experience_detected", "no_education_detected", "title_only_parse", "parser_low_confidence"]
    assert {(r.job_id, r.reject_reason) for r in rejected.collect()} == {("b", "empty_description"), ("c", "status_not_parsable")}
    python = found.filter("job_id = 'a' and normalized_value = 'python'").first()
    assert a.description_clean[python.evidence_start : python.evidence_end] == python.evidence_text == "python and SQL Server"  # the longer evidence of equal certainty


def test_queries_in_order(spark):
    job = spark.createDataFrame([("j", "Software Developer", "Bursa", None, ["Python"], ["SQL"])], "job_id string, job_title string, city string, country string, required_skills array<string>, preferred_skills array<string>")
    req = spark.createDataFrame([("j", "title", "software developer", "required", 1.0, 1.0, 0), ("j", "education", "field:x", "required", 1.0, 1.0, 1), ("j", "industry", "steel", "required", 1.0, 1.0, 2), ("j", "skill", "docker", "preferred", 1.0, 1.0, 3)], "job_id string, type string, normalized_value string, importance string, weight double, confidence double, seq long")
    made = sourcing.generate(sourcing.query_inputs(job, req), ("tr", "en"), max_queries=30)
    rows = made.orderBy("position").collect()
    # The recall queries have the keys of title_location here, so the earlier ones stay.
    assert [r.query_type for r in rows] == ["title_location"] * 2 + ["precision"] * 2 + ["title_skills"] * 2 + ["education_location", "industry_title", "required_skills"]
    assert rows[0].query_text == 'site:linkedin.com/in ("Yazılım Geliştirici" OR "Yazılım Mühendisi") "Bursa"'
    assert not any("docker" in r.query_text for r in rows)
    new, counts = sourcing.persist(made, made, spark.createDataFrame([("j", "parsed")], "job_id string, status string"))
    assert new.count() == 0 and counts.first().existing == len(rows)


def test_query_is_cut(spark):
    df = spark.createDataFrame([(["t" * 30], ["s" * 10], ["l" * 10])], "t array<string>, s array<string>, l array<string>")
    q = lambda n: df.select(sourcing.query_text(F.col("t"), F.col("s"), F.col("l"), F.lit("x.y"), n).alias("q")).first().q
    assert q(100).endswith('"llllllllll"') and q(60).endswith('"ssssssssss"') and len(q(20)) <= 20


def test_import_and_discovery(spark):
    r = [(1, 1, "https://tr.linkedin.com/in/ada?trk=1", "Ada - Dev | LinkedIn"), (1, 2, "https://www.linkedin.com/in/ada", "Ada"), (1, 3, "mailto:x", "x"), (1, 4, "https://google.com/x", "y"), (1, 5, "https://linkedin.com/company/z", "z"), (1, 6, "https://a.dev/", "Bob")]
    rec = spark.createDataFrame([(q, p, u, t, None, None, None, "in Bursa", p) for q, p, u, t in r], "query_id long, pos int, url string, title string, snippet string, displayed_name string, displayed_headline string, displayed_location string, rank int")
    valid, bad = imports.normalized_records(rec)
    unique = imports.first_of_url(valid)
    assert (valid.count(), bad.count(), unique.count()) == (5, 1, 4)
    assert imports.merged(unique, unique).count() == 0
    rows = unique.select(F.col("pos").alias("result_id"), F.col("query_id").alias("job_id"), "normalized_url", "candidate_profile_slug", "displayed_name", "displayed_headline", "displayed_location", "title", "snippet")
    none = spark.createDataFrame([], "candidate_id long, normalized_profile_url string, profile_slug string, created_at timestamp")
    got = {x.result_id: (x.action, x.reason) for x in imports.discover(rows, none).collect()}
    assert got == {1: ("create", "linkedin_profile_url"), 4: ("skip", "search_engine_result"), 5: ("skip", "non_person_linkedin_page"), 6: ("create", "personal_profile_metadata")}
    s = imports.discovery_summary(imports.discover(rows, none)).first()
    assert (s.received, s.created, s.skipped) == (4, 2, 2)


PERSON = "candidate_id long, normalized_profile_url string, profile_slug string, full_name string, headline string, city string, current_company string"


def test_duplicate_scores(spark):
    people = [(1, "u", None, "Ada Byron", "h", "c", "k"), (2, "u", None, "x", None, None, None), (3, None, None, "ada byron", "H", "C", None), (4, None, None, "Ada Byron", None, None, "K"), (5, None, None, "Ada Byrom", "h", None, None), (6, None, None, "Ada Byron", None, None, None)]
    df = spark.createDataFrame(people, PERSON)
    pairs = spark.createDataFrame([(1, i) for i in range(2, 7)], "base_id long, other_id long")
    got = {r.other_id: r.score for r in C.duplicate_scores(pairs, df).collect()}
    assert got[2] == 1.0 and got[3] == 0.95 and got[4] == 0.9 and 0.8 < got[5] < 0.89 and 6 not in got


def test_duplicates_of_a_hot_name(spark, monkeypatch):
    from rolegraph.plans import queries as Q

    # One name for 10,050 people; the two youngest alone share a slug.
    n = 10_050
    people = spark.range(n).select(F.col("id").alias("candidate_id"), F.timestamp_seconds("id").alias("created_at"), F.lit(None).cast("string").alias("normalized_profile_url"), F.when(F.col("id") >= n - 2, "s").alias("profile_slug"), F.lit("Ada Byron").alias("full_name"), *(F.lit(None).cast("string").alias(c) for c in ("headline", "city", "current_company")))
    monkeypatch.setattr(Q, "view", lambda *_: people)
    assert [tuple(r) for r in Q.duplicate_blocking(spark, "").groupBy("others").count().collect()] == [(n - 1, n)]
    assert {(r.base_id, r.other_id, r.score) for r in Q.duplicate_suggestions(spark, "").collect()} == {(n - 1, n - 2, 0.99), (n - 2, n - 1, 0.99)}


def test_best_pairs_equal_all_pairs(spark):
    pick = lambda i, k, *v: v[(i * k + i // 3) % len(v)]
    people = [(i, datetime.datetime(2020, 1, 1), pick(i, 5, None, "u1", "U1", " u1", "u2"), pick(i, 7, None, None, "s1", "s2"), pick(i, 3, "Ada Byron", "ada byron", "Bob Ray", "LinkedIn Member", None), pick(i, 11, "h", None, "g"), pick(i, 2, "c", "d", None), pick(i, 13, None, "k", "l", "m")) for i in range(60)]
    df = spark.createDataFrame(people, "candidate_id long, created_at timestamp, normalized_profile_url string, profile_slug string, full_name string, headline string, city string, current_company string").cache()
    every = C.blocked_pairs(df, cap=10**6).cache()
    scores = C.duplicate_scores(every, df).cache()
    rows = lambda x: sorted(map(tuple, x.select("base_id", "other_id", "score", "rank").collect()))
    for limit, least in ((3, 0.87), (4, 0.8)):
        assert rows(C.suggestions(C.duplicate_scores(C.best_pairs(df, limit, least), df), least, limit)) == rows(C.suggestions(scores, least, limit))
    assert sorted(map(tuple, C.blocked_counts(df).collect())) == sorted(map(tuple, every.groupBy("base_id").count().collect()))
    cols = ["base_id", "other_id", "score", "matched_fields", "reason", "rank"]
    for limit, least in ((1, 0.87), (3, 0.8), (20, 0.8)):
        assert sorted(map(tuple, C.best_duplicates(df, least, limit).select(cols).collect())) == sorted(map(tuple, C.suggestions(scores, least, limit).select(cols).collect()))


def test_duplicates_join_nothing(spark):
    # A table of keys is small as a file and large in memory; no join may broadcast it.
    df = spark.createDataFrame([(1, "u", None, "Ada Byron", "h", "c", "k")], PERSON)
    assert "Join" not in C.best_duplicates(df, 0.8, 3)._jdf.queryExecution().executedPlan().toString()


def test_quality(spark):
    cols = "candidate_id long, full_name string, normalized_profile_url string, headline string, location_raw string, city string, country string, current_title string, current_company string, about string, discovery_snippet string"
    df = spark.createDataFrame([(1, *[None] * 10), (2, "Ada", "https://www.linkedin.com/in/ada", "h", None, "c", None, "t", "k", "a", "s"), (3, "LinkedIn Member", "https://google.com/x", *[None] * 8)], cols)
    child = spark.createDataFrame([(2,)] * 3, "candidate_id long")
    got = {r.candidate_id: r for r in C.quality(df, child, child, child).collect()}
    assert (got[1].data_quality_score, len(got[1].missing_fields)) == (0.0, 11)
    assert got[2].data_quality_score == 100.0 and got[2].missing_fields == []
    assert got[3].data_quality_score == 0.0 and got[3].warnings == ["placeholder_name", "invalid_candidate_profile_url"]


def test_merge(spark):
    t = lambda d: datetime.datetime(2020, 1, d)
    people = spark.createDataFrame([(1, "A", None, t(1)), (2, "B", "h", t(2)), (3, "C", "x", t(3))], "candidate_id long, full_name string, headline string, updated_at timestamp")
    plan = spark.createDataFrame([("m", 1, 2, 1, "keep_target"), ("bad", 3, 9, 1, "keep_target")], "cluster_id string, target_id long, source_id long, source_ord int, strategy string")
    kids = spark.createDataFrame([(2, "s"), (3, "z")], "candidate_id long, v string")
    after, children, audit = C.merge(people, plan, {"experiences": kids})
    assert {(r.candidate_id, r.full_name, r.headline) for r in after.collect()} == {(1, "A", "h"), (3, "C", "x")}
    assert {(r.candidate_id, r.v) for r in children["experiences"].collect()} == {(1, "s"), (3, "z")}
    a = audit.first()
    assert a.moved_experiences == 1 and a.conflicts == ["full_name"]
    assert C.plan_errors(plan, people).first().errors == ["candidate_missing"]


def test_timeline(spark):
    d = datetime.date
    rows = [(1, d(2020, 1, 1), d(2021, 12, 1), False, None), (1, d(2021, 6, 1), d(2023, 1, 1), False, None), (1, d(2021, 6, 1), d(2023, 1, 1), False, None), (1, None, None, False, 9), (2, d(2024, 1, 1), d(2024, 2, 1), False, None), (2, d(2024, 3, 1), None, True, None), (2, d(2023, 1, 1), None, False, None)]
    df = spark.createDataFrame(rows, "candidate_id long, start_date date, end_date date, is_current boolean, duration_months int")
    assert {r.candidate_id: r.total_months for r in E.total_months(df, "2024-04-15").collect()} == {1: 46, 2: 4}


def test_enrichment_parts(spark):
    s = spark.createDataFrame([("MS SQL", None, 0.9, "inferred")], "raw_name string, category string, confidence double, source string")
    r = E.skills(s).first()
    assert (r.normalized_name, r.category, r.confidence) == ("sql server", "database", 0.5)
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "c", 1)], "candidate_id long, key string, v int")
    new = spark.createDataFrame([(1, "b", 2), (1, "d", 2)], "candidate_id long, key string, v int")
    p = lambda mode: spark.createDataFrame([(1, mode, ["skills"])], "candidate_id long, import_mode string, sections_present array<string>")
    rows = lambda df: {(x.candidate_id, x.key, x.v) for x in df.collect()}
    assert rows(E.upserted(old, new, p("merge"), ["candidate_id", "key"], "skills")) == {(1, "a", 1), (1, "b", 2), (1, "d", 2), (2, "c", 1)}
    assert rows(E.upserted(old, new, p("replace_all"), ["candidate_id", "key"], "skills")) == {(1, "b", 2), (1, "d", 2), (2, "c", 1)}
    seen = spark.createDataFrame([(1, "k", 0, "x"), (1, "k", 3, "y")], "candidate_id long, key string, pos int, v string")
    last = E.last_of_key(seen, ["candidate_id", "key"]).first()
    assert (last.pos, last.v) == (0, "y")


def test_matching_uncertain(spark):
    jobs = spark.createDataFrame([("j", "Software Developer", 3.0, "Bursa", None, "parsed")], "job_id string, title string, min_experience_years double, city string, country string, status string")
    req = spark.createDataFrame([("j", "r1", "skill", "python", "Python", "required", 0)], "job_id string, req_id string, category string, value string, raw_value string, importance string, seq int")
    cand = spark.createDataFrame([("a", "bursa", None, 36), ("b", None, None, None)], "candidate_id string, city string, country string, total_experience_months int")
    titles = spark.createDataFrame([("a", "Software Engineer")], "candidate_id string, title string")
    values = spark.createDataFrame([("a", "skill", "Python")], "candidate_id string, category string, value string")
    pairs = spark.createDataFrame([("j", "a"), ("j", "b")], "job_id string, candidate_id string")
    got = {r.candidate_id: r for r in M.score(pairs, jobs, req, cand, titles, values).collect()}
    assert (got["a"].title_score, got["a"].skill_score, got["a"].experience_score, got["a"].location_score, got["a"].total_score) == (100.0, 100.0, 100.0, 100.0, 100.0)
    assert [x["category"] for x in got["a"].matched] == ["title", "skill", "experience", "location"]
    assert got["b"].total_score == 30.0 and [x["category"] for x in got["b"].uncertain] == ["title", "skill", "experience", "location"]
    assert got["b"].explanation == "Total fit: %30. Matched: No strong matches. Missing: none. Uncertain: title, skill."


def test_pages(spark):
    html = "<div class='g'><a href='https://a.b/c'>Ada <b>B</b></a><p>snippet</p></div><script>x</script><article><a href='/r'>R</a></article>"
    rec, rejected = pages.result_records(spark.createDataFrame([(1, html), (2, "<p>see <a href='u'>long title</a> now</p>"), (3, None)], "page_id long, html string"))
    assert {(r.page_id, r["rank"], r.url, r.title, r.snippet) for r in rec.collect()} == {(1, 1, "https://a.b/c", "Ada B", "snippet"), (1, 2, "/r", "R", None), (2, 1, "u", "long title", "see  now")}
    assert rejected.first().reject_reason == "empty_page"
    profile = "<section data-section='top-card'><h1 data-field='name'>Demo Engineer</h1></section><section data-section='skills'><ul><li>Python</li><li>SQL</li></ul></section>"
    p = pages.profile_fields(spark.createDataFrame([("1", profile)], "page_id string, html string")).first()
    assert (p.full_name, p.skills, p.experience) == ("Demo Engineer", [], []) and "experience_missing" in p.warnings and "skills_missing" not in p.warnings


def test_profile_pages(spark):
    item = "<li><h3>{}</h3><p class='company'><a href='https://c.d/x'>{}</a></p><time>{}</time></li>"
    jobs = item.format("Engineer", "Acme", "Mart 2020 – halen") + item.format("", "Nobody", "2001") + item.format("Lead", "", "May 2010 - Jan 2009") + item.format("Intern", "B", "")
    page = f"<h1>Outside</h1><section data-section='top-card'><h1>Ada</h1><i aria-label='Open to Work now'></i></section><div class='headline'>outside</div><section class='about'><div class='description'>{'x' * 30000}</div></section><ul id='experience'>{jobs}</ul><ul id='skills'><li><h4>Python</h4> 7 endorsements</li><li><h4>python</h4></li></ul><ul id='education'></ul>"
    df = spark.createDataFrame([("1", page), ("2", None), ("3", ""), ("4", "<p>no card</p>")], "page_id string, html string").withColumn("x", F.lit(1))
    got = {r.page_id: r for r in pages.profile_fields(df).collect()}
    one = got["1"]
    assert (one.full_name, one.headline, one.open_to_work, len(one.about)) == ("Ada", None, True, 30000)
    assert [(e.position_title_raw, e.company_name, str(e.start_date), e.is_current, e.sort_order) for e in one.experience] == [("Engineer", "Acme", "2020-03-01", True, 0), ("Lead", None, "2010-05-01", False, 2), ("Intern", "B", "None", False, 3)]
    assert [x for x in one.warnings if "missing" not in x] == ["item_parse_failed", "invalid_date_range", "date_parse_failed"]
    assert [(x.raw_name, x.endorsement_count) for x in one.skills] == [("Python", 7)] and one.education == [] and "education_missing" not in one.warnings
    for i in "234":
        assert got[i].full_name is None and got[i].experience == [] and "top_card_missing" in got[i].warnings
    cut = pages.profile_fields(df, most_about=20000, most_items={"experience": 1}).filter("page_id = '1'").first()
    assert len(cut.about) == 20000 and len(cut.experience) == 1
    rows = pages.profile_section(pages.profile_fields(df), "experience").withColumn("candidate_id", F.col("page_id"))
    assert [r.position_title_normalized for r in E.experiences(rows, "2021-01-01").orderBy("pos").collect()][1:] == ["lead", "intern"]
    assert pages.profile_fields(df.limit(0)).count() == 0


def test_sources(spark):
    good, bad = tables.json_results(spark.createDataFrame([("q", '[{"url": "u", "rank": 1}]'), ("p", "{")], "query_id string, value string"))
    assert good.first().url == "u" and bad.first().query_id == "p"
    urls, wrong = tables.url_records(spark.createDataFrame([("q", "a\n\nb"), ("e", " \n"), ("n", None), ("m", "u\n" * 501)], "query_id string, value string"))
    assert [r.url for r in urls.collect()] == ["a", "b"] and {tuple(r) for r in wrong.collect()} == {("e", "empty_import"), ("n", "empty_import"), ("m", "too_many_results")}
    ok, wrong = tables.payloads(spark.createDataFrame([('{"payload_id": "1", "candidate_id": "c", "skills": [{"raw_name": "x"}]}',), ("no",)], "value string"))
    assert tables.section(ok, "skills").first().raw_name == "x" and wrong.count() == 1
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = tables.upsert(stored, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, tables.upsert(once, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_shortlist_export_is_whole(spark):
    n = 10_050
    rows = spark.range(n).select(F.lit(1).alias("job_id"), F.col("id").alias("candidate_id"), F.lit("=x").alias("full_name"), F.lit(None).cast("double").alias("total_score"), F.timestamp_seconds("id").alias("created_at"))
    assert tables.shortlist_export(rows).count() == n and tables.shortlist_export(rows, most=7).count() == 7


def test_statuses_and_rules(spark):
    c = spark.createDataFrame([("draft", "parsed"), ("draft", "completed"), ("parsed", "parsed")], "from_status string, to_status string")
    assert {(r.from_status, r.to_status): r.allowed for r in shortlists.checked(c, "job").collect()} == {("draft", "parsed"): True, ("draft", "completed"): False, ("parsed", "parsed"): True}
    ok, bad = R.split_valid(spark.createDataFrame([(1, 2), (3, 2), (None, 1)], "a int, b int"), {"order": "a <= b"})
    assert ok.count() == 2 and bad.first().violations == ["order"]
    assert R.buckets(spark.createDataFrame([(10.0,), (70.0,)], "s double"), "s").collect()[2].n == 0


def test_stream(spark, tmp_path):
    from rolegraph.streaming.imports import start_import

    schema = "query_id long, pos int, url string, title string, snippet string, displayed_name string, displayed_headline string, displayed_location string, rank int"
    rows = [(1, i, f"https://a.b/{i % 3}", None, None, None, None, None, i) for i in range(6)]
    for k in range(2):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        start_import(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 3


EXPERIENCE = "candidate_id long, pos int, external_key string, position_title_raw string, company_name string, company_url string, location string, start_date date, end_date date, is_current boolean, duration_months int, skills_detected array<string>, confidence double, sort_order int"
EDUCATION = "candidate_id long, pos int, external_key string, institution_name string, degree string, field_of_study string, start_year int, end_year int, source string, confidence double"
SKILL = "candidate_id long, pos int, raw_name string, category string, endorsement_count int, source string, confidence double"
CERTIFICATION = "candidate_id long, pos int, external_key string, name string, issuer string, issue_date date, expiration_date date, credential_id string, credential_url string, source string, confidence double"
LANGUAGE = "candidate_id long, pos int, language string, proficiency string, source string, confidence double"
CANDIDATE = "candidate_id long, full_name string, normalized_profile_url string, headline string, about string, location_raw string, city string, country string, current_title string, current_company string, discovery_snippet string, total_experience_months int, profile_status string, data_quality_score double, last_scraped_at timestamp"


def test_import_enrichment(spark):
    day = datetime.date
    people = spark.createDataFrame([(i, "Ada Byron", "https://www.linkedin.com/in/ada", None, None, None, None, None, None, None, None, None, "discovered", 1.0, None) for i in (1, 2, 3, 4)], CANDIDATE)
    job = lambda i, pos, title, a, z, now=False: (i, pos, None, title, "Acme", None, None, a, z, now, None, [], 0.9, pos)
    skill = lambda i, pos, name, conf=0.5: (i, pos, name, None, None, "profile_skill", conf)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    stored = {
        "experience": frame([job(1, 1, "Software Developer", day(2020, 1, 1), day(2020, 12, 31)), job(2, 1, "Cook", day(2010, 1, 1), day(2010, 6, 30))], EXPERIENCE), "education": frame([(1, 1, "EXT", "MIT", None, None, None, None, "manual", 1.0)], EDUCATION),
        "skill": frame([skill(1, 1, "python"), skill(2, 1, "java"), skill(2, 2, "go")], SKILL), "certification": frame([], CERTIFICATION), "language": frame([(1, 1, "English", None, "manual", 1.0)], LANGUAGE),
    }
    incoming = {
        "experience": frame([job(1, 1, " Software  developer ", day(2020, 1, 1), day(2020, 12, 31)), job(1, 2, "Planning Engineer", day(2021, 1, 1), None, True)], EXPERIENCE),
        "education": frame([(1, 1, "ext", "M.I.T.", "BSc", "Computer Engineering", 2000, 2004, "Manual", 1.0), (3, 1, None, "X", None, None, 2004, 2000, "manual", 1.0)], EDUCATION),
        "skill": frame([skill(1, 1, "Python", 0.7), skill(1, 2, "sql"), skill(1, 3, "SQL", 0.6), skill(2, 1, "docker")], SKILL),
        "certification": frame([(1, 1, None, "ISO9001", "TUV", None, None, "C-1", "https://x.example/c", "manual", 1.0), (1, 2, None, "iso 9001", "tuv", None, None, "c-1", None, "manual", 1.0)], CERTIFICATION),
        "language": frame([(1, 1, "Ingilizce", "fluent", "manual", 1.0), (1, 2, "english", "good", "manual", 1.0)], LANGUAGE),
    }
    payloads = frame([(1, "deep", "merge", "fill_empty", [], False, "Bob", "Dev at Acme", "about", "Bursa"), (2, "basic", "replace_sections", "overwrite_non_null", ["skill"], True, "Eve", None, None, None), (3, "deep", "replace_all", "fill_empty", [], False, "Zed", None, None, None)], "candidate_id long, mode string, import_mode string, identity_update_strategy string, sections_present array<string>, is_partial boolean, full_name string, headline string, about string, location_raw string")
    out, after, runs = E.import_enrichment(people, stored, payloads, incoming, "2022-06-15 10:00:00")
    got, run = {r.candidate_id: r for r in out.collect()}, {r.candidate_id: r for r in runs.collect()}
    assert (got[1].full_name, got[1].headline, got[1].current_title, got[1].total_experience_months, got[1].profile_status) == ("Ada Byron", "Dev at Acme", "Planning Engineer", 12 + 18, "scraped")
    assert str(got[1].last_scraped_at) == "2022-06-15 10:00:00" and got[2].last_scraped_at is None and got[2].full_name == "Eve" and got[2].profile_status == "partial"
    assert (run[1].status, run[1].experience_created, run[1].experience_updated, run[1].skill_created, run[1].skill_updated, run[1].education_updated, run[1].certification_created, run[1].language_created + run[1].language_updated) == ("completed", 1, 1, 1, 1, 1, 1, 1)
    assert (run[2].status, run[2].skill_created, run[2].skill_deleted, run[2].experience_deleted) == ("partial", 1, 2, 0)
    assert (run[3].status, run[3].errors) == ("failed", ["education:year_range"]) and got[3].full_name == "Ada Byron" and got[4].profile_status == "discovered"
    assert {r.normalized_name for r in after["skill"].filter("candidate_id = 2").collect()} == {"docker"} and after["experience"].filter("candidate_id = 2").count() == 1
    before, later = {r.candidate_id: (r.quality_before, r.quality_after) for r in runs.collect()}[1]
    assert later > before and got[1].data_quality_score == later
    same, _, seen = E.import_enrichment(people, stored, payloads, incoming, "2022-06-15 10:00:00", preview=True)
    assert same is people and {r.status for r in seen.collect()} == {"preview", "failed"}


def test_merge_consolidates_children(spark):
    people = spark.createDataFrame([(i, n, u, None, None, "Bursa" if i == 1 else None, None, None, None, "Acme" if i == 2 else None, None, 5, "partial", 9.0, None) for i, n, u in ((1, "Ada", None), (2, "Ada Byron", "https://a.example/x"), (3, "Other", None), (4, "Eve", None))], CANDIDATE).withColumn("updated_at", F.to_timestamp(F.lit("2020-01-01")))
    plan = spark.createDataFrame([("k", 1, 2, 1, "keep_target"), ("bad", 3, 3, 1, "keep_target")], "cluster_id string, target_id long, source_id long, source_ord int, strategy string")
    children = {
        "skills": spark.createDataFrame([(1, "python", "manual", 0.5, None), (2, "Python", "manual", 0.9, 4), (2, "sql", "manual", 0.2, 1), (4, "go", "manual", 0.1, 1)], "candidate_id long, normalized_name string, source string, confidence double, endorsement_count int"),
        "languages": spark.createDataFrame([(1, "english", 0.3, ""), (2, "english", 0.8, "fluent")], "candidate_id long, language_normalized string, confidence double, proficiency string"),
        "shortlist": spark.createDataFrame([(7, 1, "new", "mine"), (7, 2, "reviewed", "theirs"), (8, 2, "new", "only")], "job_id long, candidate_id long, status string, note string"),
        "matches": spark.createDataFrame([(7, 1, 50.0, "a", ["x"]), (7, 2, 60.0, "b", ["x", "y"])], "job_id long, candidate_id long, total_score double, explanation string, matched_requirements array<string>"),
        "experiences": spark.createDataFrame([(2, "t")], "candidate_id long, title string"), "educations": spark.createDataFrame([], "candidate_id long"),
    }
    own = spark.createDataFrame([("k", "Countess")], "cluster_id string, headline string")
    out, moved, audit = C.merge(people, plan, children, own)
    got = {r.candidate_id: r for r in out.collect()}
    assert set(got) == {1, 3, 4} and (got[1].full_name, got[1].headline, got[1].current_company) == ("Ada", "Countess", "Acme")
    assert got[1].data_quality_score > 9 and got[4].data_quality_score == 9.0
    assert {(r.candidate_id, r.normalized_name, r.confidence, r.endorsement_count) for r in moved["skills"].collect()} == {(1, "python", 0.9, 4), (1, "sql", 0.2, 1), (4, "go", 0.1, 1)}
    assert [tuple(r) for r in moved["languages"].select("candidate_id", "confidence", "proficiency").collect()] == [(1, 0.8, "fluent")]
    assert {(r.job_id, r.candidate_id, r.status, r.note) for r in moved["shortlist"].collect()} == {(7, 1, "new", "mine\n\n[merged from 2]\ntheirs"), (8, 1, "new", "only")}
    match = moved["matches"].first()
    assert (match.total_score, match.explanation, match.matched_requirements) == (50.0, "a\n\n[merged from 2]\nb", ["x", "y"])
    a = audit.first()
    assert audit.count() == 1 and (a.moved_skills, a.moved_languages, a.moved_shortlist, a.moved_experiences, a.moved_educations) == (2, 1, 2, 1, 0)
    assert C.merge(people, plan, children, preview=True)[0] is people


def test_result_pages(spark):
    boxed = '<div data-result><p>first</p><a href="https://a.example/1">One</a><a href="/2">Two</a></div><article><a href="u" title="T"></a><span class="snippet">s <b>x</b></span></article><div class="g"><p>no link</p></div><a href="outside">Outside</a>'
    loose = '<p>Read <a href="https://b.example">the paper</a> now</p><a href="x">ab</a><script><a href="no">nono</a></script>'
    pages_ = spark.createDataFrame([(1, boxed), (2, loose), (3, None), (4, "x" * 50), (5, "")], "page_id long, html string")
    found, rejected = pages.result_records(pages_, most_bytes=1000)
    assert {tuple(r) for r in found.collect()} == {(1, 1, "https://a.example/1", "One", "first"), (1, 2, "u", "T", "s x"), (2, 1, "https://b.example", "the paper", "Read  now")}
    assert {tuple(r) for r in rejected.collect()} == {(3, "empty_page")}
    assert {tuple(r) for r in pages.result_records(pages_, most_bytes=40)[1].collect()} == {(1, "page_too_large"), (2, "page_too_large"), (3, "empty_page"), (4, "page_too_large")}


def one_by_one(people, plans, notes):
    """Merges as requests that follow each other."""
    people, notes, rejected, clock = {k: dict(v) for k, v in people.items()}, {k: dict(v) for k, v in notes.items()}, set(), 100
    for cluster, target, sources, strategy, value in plans:
        if not {target, *sources} <= people.keys() or target in sources or len(set(sources)) < len(sources):
            rejected.add(cluster)
            continue
        members = [people[target], *(people[s] for s in sources)]
        for f in ("full_name", "city"):
            order = sorted(members, key=lambda m: -m["at"]) if strategy == "prefer_newest" else members
            people[target][f] = next((m[f] for m in order if (m[f] or "").strip()), None)
        people[target]["city"] = value or people[target]["city"]
        people[target]["at"] = clock = clock + 1
        for s in sources:
            for job, note in notes.pop(s, {}).items():
                mine = notes.setdefault(target, {})
                if job not in mine or not (mine[job] or "").strip():
                    mine[job] = note
                elif (note or "").strip() and note.strip() != mine[job].strip():
                    mine[job] = f"{mine[job]}\n\n[merged from {s}]\n{note}"
            del people[s]
    return people, notes, rejected


def test_overlapping_merge_plans_equal_one_after_the_other(spark):
    import random

    rng = random.Random(4)
    people, notes, plans = {}, {}, []
    for case in range(12):
        ids = [case * 100 + i for i in range(14)]
        for i in ids:
            people[i] = {"full_name": rng.choice(["A", "B", None]), "city": rng.choice(["X", " ", None, f"c{i}"]), "at": rng.randrange(50)}
            notes[i] = {j: rng.choice(["n", "m", "", f"note {i}"]) for j in range(3) if rng.random() < 0.5}
        for n in range(10):
            sources = rng.sample(ids, rng.randint(1, 3)) + ([ids[0]] if rng.random() < 0.2 else [])
            plans.append((case * 1000 + n, rng.choice(ids), sources, rng.choice(["keep_target", "prefer_non_empty", "prefer_newest"]), rng.choice([None, None, "set"])))
    want, want_notes, rejected = one_by_one(people, plans, notes)
    assert 20 < len(rejected) < len(plans) - 20
    stamp = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)
    frame = spark.createDataFrame([(i, p["full_name"], p["city"], stamp(p["at"])) for i, p in people.items()], "candidate_id long, full_name string, city string, updated_at timestamp")
    plan = spark.createDataFrame([(c, c, t, s, n, how) for c, t, ss, how, _ in plans for n, s in enumerate(ss, 1)], "cluster_id long, plan_ord long, target_id long, source_id long, source_ord int, strategy string")
    shortlist = spark.createDataFrame([(j, i, "new", t) for i, own in notes.items() for j, t in own.items()], "job_id long, candidate_id long, status string, note string")
    own = spark.createDataFrame([(c, v) for c, *_, v in plans], "cluster_id long, city string")
    out, children, audit = C.merge(frame, plan, {"shortlist": shortlist}, own)
    assert {r.candidate_id: (r.full_name, r.city) for r in out.collect()} == {i: (p["full_name"], p["city"]) for i, p in want.items()}
    assert {(r.candidate_id, r.job_id): r.note for r in children["shortlist"].collect()} == {(i, j): t for i, own in want_notes.items() for j, t in own.items()}
    assert {r.cluster_id for r in audit.collect()} == {c for c, *_ in plans} - rejected
    assert {r.cluster_id for r in C.resolved(plan, frame, own)[1].collect()} == rejected


@pytest.mark.parametrize("mode", ["merge", "replace"])
def test_import_batches_follow_each_other(spark, mode):
    """Summaries and storage are those of one import after the other; also of what only other queries have."""
    import random

    rng = random.Random(8)
    stored = {q: {f"https://x.example/{rng.randrange(12)}" for _ in range(rng.randrange(5))} for q in range(6)}
    batch = {q: [rng.choice([f"https://x.example/{rng.randrange(12)}", f"HTTPS://u:p@X.example/{rng.randrange(12)}/", "mailto:x", None]) for _ in range(rng.randrange(1, 12))] for q in range(2, 9)}
    have, want = {q: set(u) for q, u in stored.items()}, {}
    for q in sorted(batch):
        valid = [f"https://x.example/{u.rstrip('/').rpartition('/')[2]}" for u in batch[q] if u and u != "mailto:x"]
        mine = have.get(q, set()) if mode == "merge" else set()
        new = set(valid) - mine
        other = {u for u in new if any(u in x for p, x in have.items() if p != q)}
        have[q] = mine | new
        want[q] = (len(batch[q]), len(valid), len(batch[q]) - len(valid), len(valid) - len(set(valid)) + len(set(valid) & mine) + len(other), len(new), len(have[q]))
    records = spark.createDataFrame([(q, n, u, None, None, None, None, None, 1) for q, us in batch.items() for n, u in enumerate(us)], "query_id long, pos int, url string, title string, snippet string, displayed_name string, displayed_headline string, displayed_location string, rank int")
    before = spark.createDataFrame([(q, u) for q, us in stored.items() for u in us], "query_id long, normalized_url string")
    new, kept, invalid, summary = imports.import_batch(records, before, mode)
    assert {tuple(r)[0]: tuple(r)[1:] for r in summary.select("query_id", "received", "valid", "invalid", "duplicate", "inserted", "total").collect()} == want
    rows = kept.select("query_id", "normalized_url").unionByName(new.select("query_id", "normalized_url")).collect()
    assert sorted(map(tuple, rows)) == sorted((q, u) for q, us in have.items() for u in us)
    assert invalid.count() == sum(w[2] for w in want.values()) and imports.import_batch(records.limit(0), before, mode)[3].count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_pages_at_any_depth(spark, descending):
    """Hot sort values and nulls: pages are those of the sorted list, and each is read from the ranges that it lies in."""
    rows = [(i, None if i % 7 == 0 else 3 if i % 3 else i % 50, i) for i in range(2003)]
    df = spark.createDataFrame(rows, "key long, s long, _place long").repartition(5)
    want = sorted(rows, key=lambda r: (((r[1] is not None) if descending else r[1] is None), (-1 if descending else 1) * (r[1] or 0), r[0]))
    o = R.Ordered(df, "s", "key", ["s"], descending, partitions=4)
    assert o.total == 2003 and len(o.ranges) > 1 and max(n for _, n in o.ranges) < 1500
    for number, size in ((1, 20), (57, 20), (101, 20), (102, 20), (3, 700)):
        assert [tuple(r) for r in o.page(number, size).collect()] == want[(number - 1) * size : number * size]
    assert R.Ordered(df.limit(0), "s", "key", ["s"]).page().count() == 0
    with pytest.raises(ValueError):
        R.Ordered(df, "key", "key", ["s"])


def test_similar_keys_equal_every_pair(spark):
    import random

    rng = random.Random(9)
    words = [f"w{n}" for n in range(9)]
    some = lambda n: [(c, " ".join(rng.sample(words, rng.randint(0, 9)))) for c in ("skill", "education") for _ in range(n)]
    left, right = sorted(set(some(150))), sorted(set(some(150)))
    frame = lambda rows, k, t: spark.createDataFrame([(c, v, v.split()) for c, v in rows], f"category string, {k} string, {t} array<string>")
    near = lambda c, a, b: len(a & b) and 100 * len(a & b) >= (85 if c == "skill" else 80) * len(a | b)
    want = {(c, a, b) for c, a in left for d, b in right if c == d and near(c, set(a.split()), set(b.split()))}
    assert any(set(a.split()) != set(b.split()) for _, a, b in want)
    assert sorted(map(tuple, M.similar_keys(frame(left, "rk", "rt"), frame(right, "k", "t")).collect())) == sorted(want)


def test_a_word_that_all_keys_hold_is_no_join_key(spark):
    """20,000 keys a side that hold one word, of a few tokens and of many: all pairs would be 400 million."""
    keys = spark.range(20_000).selectExpr("'skill' AS category", "if(id % 2 = 0, concat_ws(' ', 'engineer', 'of', id), concat_ws(' ', 'engineer', 'of', 'the', 'very', 'large', 'team', id, id + 1, id + 3)) AS key")
    side = lambda k, t: keys.select("category", F.col("key").alias(k), F.split("key", " ").alias(t))
    found = M.similar_keys(side("rk", "rt"), side("k", "t"))
    assert found.count() == 20_000 and found.filter("rk <> k").count() == 0


def test_merge_plans_that_set_fields(spark):
    people = spark.createDataFrame([(i, f"P{i}", None, None, None, None) for i in range(8)], "candidate_id long, full_name string, primary_profile_url string, normalized_profile_url string, profile_slug string, total_experience_months int").withColumn("updated_at", F.current_timestamp())
    plan = spark.createDataFrame([(n, 2 * n, 2 * n + 1, 1, "keep_target") for n in range(4)], "cluster_id long, target_id long, source_id long, source_ord int, strategy string")
    own = spark.createDataFrame([(0, "https://Ex.com/a#b", None, None), (1, None, -1, None), (2, None, None, "slug")], "cluster_id long, primary_profile_url string, total_experience_months int, profile_slug string")
    out, _, audit = C.merge(people, plan, {}, own)
    got = {r.candidate_id: r for r in out.collect()}
    assert set(got) == {0, 2, 3, 4, 5, 6} and got[0].normalized_profile_url == "https://ex.com/a" and audit.count() == 2
    assert {(r.cluster_id, *r.errors) for r in C.resolved(plan, people, own)[1].collect()} == {(1, "invalid_months"), (2, "protected_fields")}
    assert C.merge(people, plan.limit(0), {})[2].count() == 0 and C.merge(people.limit(0), plan, {})[0].count() == 0


@pytest.mark.parametrize("html", ["<p>x " * 100_000, "<div>" * 100_000 + "<a href='u'>some link</a>", "<ul id='skills'>" + "<li>x " * 1200, "<b>" * 50_000 + "</i>" * 50_000])
def test_deep_pages(spark, html):
    """Unclosed and nested tags: no recursion, and end tags that close nothing cost nothing."""
    df = spark.createDataFrame([("1", html)], "page_id string, html string")
    found, _ = pages.result_records(df)
    assert found.count() == html.count("<a ")
    row = pages.profile_fields(df).first()
    assert row.full_name is None and [len(x.raw_name or "") for x in row.skills] == []


def test_many_links_in_one_parent(spark):
    """Texts are places in one buffer: what a page gives is linear in it, though each record's snippet is long."""
    html = "<div>" + "".join(f"<a href='/{n}'>link {n}</a> " for n in range(60_000)) + "</div>"
    assert len(html) < pages.MOST_BYTES
    read = pages._records(html)
    assert len(read["body"]) < len(html) and len(read["records"]) == 60_000 and all(len(str(r)) < 200 for r in read["records"])
    found, _ = pages.result_records(spark.createDataFrame([(1, html)], "page_id long, html string"), most_snippet=20)
    rows = {r["rank"]: r for r in found.filter("rank in (1, 2, 60000)").collect()}
    assert (rows[2].url, rows[2].title, rows[2].snippet) == ("/1", "link 1", "link 0  link 2 link ")
    assert found.count() == 60_000 and rows[60_000].title == "link 59999"


def test_items_that_repeat_each_other(spark, monkeypatch):
    monkeypatch.setattr(pages, "MOST_ITEM_BYTES", 10_000)
    html = "<ul id='skills'>" + "<li><h4>x</h4> y " * 300 + "</ul><ul id='languages'><li><h3>English</h3></li></ul>"
    row = pages._profile(html, {})
    assert row["skills"] == [] and "skills_too_large" in row["warnings"] and len(row["languages"]) == 1


def test_match_entries_and_upsert(spark):
    p = spark.createDataFrame([("j", "a"), ("j", "b")], "job_id string, candidate_id string")
    jobs = spark.createDataFrame([("j", "software engineer", None, None, None, "parsed")], "job_id string, title string, min_experience_years double, city string, country string, status string")
    req = spark.createDataFrame([("j", "skill", 1, "python", "Python", "required", 0), ("j", "industry", 2, "steel", "Steel", "optional", 1)], "job_id string, category string, req_id int, value string, raw_value string, importance string, seq int")
    people = spark.createDataFrame([("a", None, None, None), ("b", None, None, None)], "candidate_id string, city string, country string, total_experience_months int")
    titles = spark.createDataFrame([("a", "developer software team")], "candidate_id string, title string")
    values = spark.createDataFrame([("a", "skill", "python"), ("a", "industry", "mining")], "candidate_id string, category string, value string")
    got = M.score(p, jobs, req, people, titles, values)
    a = got.filter("candidate_id = 'a'").first()
    assert [(x.category, x.importance, x.score) for x in a.matched] == [("skill", "required", None)]
    assert [(x.category, x.importance, x.score) for x in a.missing] == [("title", None, 66.7), ("industry", None, None)]
    old = spark.createDataFrame([("j", "a", 1.0, "old"), ("k", "a", 2.0, "old")], "job_id string, candidate_id string, total_score double, version string")
    new = M.stored(old, got.select(old.columns))
    assert {(r.job_id, r.candidate_id, r.version) for r in new.collect()} == {("j", "a", "rule-v1"), ("j", "b", "rule-v1"), ("k", "a", "old")}
    with pytest.raises(ValueError):
        M.listing(old, people, sort="city")


def test_pages_of_groups(spark):
    rows = spark.createDataFrame([(g, i, None if i == 3 else i % 4) for g in "ab" for i in range(7 if g == "a" else 2)], "g string, id int, v int")
    first, meta = R.page_each(rows, "g", "v", "id", ["v"], descending=True, size=3)
    assert [r.id for r in first.filter("g = 'a'").orderBy("rank").collect()] == [3, 2, 6]
    second = R.page_each(rows, "g", "v", "id", ["v"], number=2, size=3)[0]
    assert [(r.g, r.id, r["rank"]) for r in second.orderBy("g", "rank").collect()] == [("a", 5, 4), ("a", 2, 5), ("a", 6, 6)]
    assert {(r.g, r.total, r.pages) for r in meta.collect()} == {("a", 7, 3), ("b", 2, 1)}
    assert R.page_each(rows.limit(0), "g", "v", "id", ["v"])[1].count() == 0
    with pytest.raises(ValueError):
        R.page_each(rows, "g", "id", "id", ["v"])


def test_export_files(spark, tmp_path):
    e = spark.createDataFrame([("j", "b", "=1", 2.5, "new"), ("j", "a", None, None, "new"), ("k", "c", "Zoë", 1.0, None)], "job_id string, candidate_id string, full_name string, total_score double, status string").withColumn("created_at", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    out = tables.shortlist_export(e)
    assert out.columns[2:] == list(tables.EXPORT.values())
    tables.write_csv(out, str(tmp_path / "x"))
    texts = [f.read_text(encoding="utf-8") for f in sorted((tmp_path / "x" / "job_id=j").glob("*.csv"))]
    assert texts and all(t.startswith("\ufeffcandidate_name,headline,") for t in texts)
    lines = [line for t in texts for line in t.splitlines()[1:]]
    assert len(lines) == 2 and lines[1].startswith("'=1,") and ",2.5,new," in lines[1] and "2024-01-02T03:04:05Z" in lines[1]
