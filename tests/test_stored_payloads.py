"""Stored tables in buckets (S8-S10) and payload checks."""

import glob
import json
import os

from rolegraph.sources import payload_checks as P
from rolegraph.sources.stored import Stored


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def times(folder):
    return {os.path.dirname(f): (os.path.basename(f), os.stat(f).st_mtime_ns) for f in glob.glob(f"{folder}/bucket*/*.parquet")}


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    folder = f"{tmp_path}/t"
    t = Stored(spark, folder, "k long, v string", ["k"], buckets=16)
    t.overwrite(spark.range(200).selectExpr("id AS k", "'old' AS v"))
    before = times(folder)
    assert len(before) == 16
    new = spark.createDataFrame([(5, "b", 2), (5, "z", 1), (900, "n", 1)], "k int, v string, at int")  # another type, an extra column, a repeated key
    t.upsert(new, ["at"])
    once, after = rows(t.read()), times(folder)
    assert once == sorted([*((k, "old") for k in range(200) if k != 5), (5, "b"), (900, "n")], key=str)
    assert 1 <= sum(before[d] != after[d] for d in before) <= 2
    t.upsert(new, ["at"])
    assert rows(t.read()) == once


def test_rows_derived_from_the_table_itself(spark, tmp_path):
    t = Stored(spark, f"{tmp_path}/t", "k long, v long", ["k"], buckets=4)
    t.overwrite(spark.range(50).selectExpr("id AS k", "0L AS v"))
    t.upsert(t.read().filter("k % 2 = 0").selectExpr("k", "v + 1 AS v"))
    assert rows(t.read()) == sorted(((k, 1 - k % 2) for k in range(50)), key=str)


def test_insert_absent_appends_only(spark, tmp_path):
    folder = f"{tmp_path}/t"
    t = Stored(spark, folder, "bucket string, v int", ["bucket"], buckets=8)  # a column that clashes with the bucket's own name
    t.overwrite(spark.createDataFrame([("a", 1), (None, 2)], "bucket string, v int"))
    files = set(glob.glob(f"{folder}/*/*.parquet"))
    new = spark.createDataFrame([("a", 9), (None, 9), ("b", 4), ("b", 3)], "bucket string, v int")
    for _ in range(2):
        t.insert_absent(new)
        assert rows(t.read()) == sorted([("a", 1), (None, 2), ("b", 3)], key=str)
    assert files <= set(glob.glob(f"{folder}/*/*.parquet"))


def test_replaced_children(spark, tmp_path):
    t = Stored(spark, f"{tmp_path}/t", "p string, v int", ["p"], buckets=64)
    old = [(p, i) for p in "abcdef" for i in range(3)] + [(None, 0)]
    t.overwrite(spark.createDataFrame(old, "p string, v int"))
    new = spark.createDataFrame([("a", 7), ("a", 7), ("g", 1)], "p string, v int")
    gone = spark.createDataFrame([("b",), (None,), ("unknown",)], "p string")
    want = sorted([("a", 7), ("a", 7), ("g", 1), *(r for r in old if r[0] and r[0] in "cdef")], key=str)
    for _ in range(2):
        t.replace_children(new, gone)
        assert rows(t.read()) == want
    t.replace_children(new.limit(0))
    assert rows(t.read()) == want


def test_empty_tables(spark, tmp_path):
    nothing = spark.createDataFrame([], "k long, v string")
    t = Stored(spark, f"{tmp_path}/t", "k long, v string", ["k"], buckets=4)
    t.overwrite(nothing)
    for write in (t.upsert, t.insert_absent, t.replace_children):
        write(nothing)
    assert rows(t.read()) == []
    t.upsert(spark.createDataFrame([(1, "a")], "k long, v string"))
    t.replace_children(nothing, spark.createDataFrame([(1,)], "k long"))
    assert rows(t.read()) == []


GOOD = {
    "candidate_id": "c", "provider": "manual", "mode": "deep", "identity": {"full_name": {"value": " Ada ", "evidence": None}, "open_to_work": {"value": True}, "about": None},
    "experiences": [{"position_title_raw": "Dev", "start_date": "2020-01-01", "end_date": "2021-01-01", "is_current": False, "skills_detected": ["x"], "duration_months": 3}],
    "educations": [{"institution_name": "U", "start_year": 2000, "end_year": 2004}], "skills": [{"raw_name": "SQL", "source": "inferred", "confidence": 0.5}], "certifications": [{"name": "C", "issue_date": "2020-02-29"}], "languages": [{"language": "en"}],
}


def test_payload_rules(spark):
    exp, edu, cert = GOOD["experiences"][0], GOOD["educations"][0], GOOD["certifications"][0]
    cases = {
        "good": (GOOD, []),
        "least": ({"candidate_id": "c"}, []),
        "null": (None, [("payload", None, None, "invalid_json")]),
        "list": ([GOOD], [("payload", None, None, "invalid_json")]),
        "keys": (GOOD | {"b": 1, "a": {}}, [("payload", None, "a", "unknown_key"), ("payload", None, "b", "unknown_key")]),
        "missing": ({"mode": None, "skills": [{}]}, [("payload", None, "candidate_id", "missing"), ("payload", None, "mode", "wrong_type"), ("skills", 0, "raw_name", "missing")]),
        "identity": ({"candidate_id": "c", "identity": {"city": {"value": "x" * 20_001, "more": 1}, "open_to_work": {"value": "perhaps"}, "headline": "h"}}, [("identity", None, "city.value", "too_long"), ("identity", None, "city.more", "unknown_key"), ("identity", None, "open_to_work.value", "wrong_type"), ("identity", None, "headline", "wrong_type")]),
        "dates": ({"candidate_id": "c", "experiences": [exp | {"end_date": "2019-12-31"}, exp | {"is_current": True}, exp | {"start_date": "2020-1-1"}]}, [("experiences", 0, "end_date", "end_before_start"), ("experiences", 1, "end_date", "current_with_end"), ("experiences", 2, "start_date", "wrong_type")]),
        "years": ({"candidate_id": "c", "educations": [edu | {"end_year": 1999}, edu | {"start_year": 1899}, edu | {"start_year": 2000.5}]}, [("educations", 0, "end_year", "end_before_start"), ("educations", 1, "start_year", "out_of_range"), ("educations", 2, "start_year", "wrong_type")]),
        "certs": ({"candidate_id": "c", "certifications": [cert | {"expiration_date": "2020-02-28"}, cert | {"issue_date": "2021-02-29"}, cert | {"credential_id": "i" * 256}]}, [("certifications", 0, "expiration_date", "end_before_start"), ("certifications", 1, "issue_date", "wrong_type"), ("certifications", 2, "credential_id", "too_long")]),
        "sizes": ({"candidate_id": "c", "languages": [{"language": "l"}] * 51, "skills": "x"}, [("payload", None, "skills", "wrong_type"), ("payload", None, "languages", "too_many")]),
        "numbers": ({"candidate_id": "c", "skills": [{"raw_name": "s", "confidence": "high"}, {"raw_name": "s", "confidence": 1.01}, {"raw_name": "s", "source": "guess", "endorsement_count": -1}]}, [("skills", 0, "confidence", "wrong_type"), ("skills", 1, "confidence", "out_of_range"), ("skills", 2, "endorsement_count", "out_of_range"), ("skills", 2, "source", "not_listed")]),
    }
    lines = spark.createDataFrame([(n, None if p is None else json.dumps(p)) for n, (p, _) in cases.items()] + [("cut", '{"candidate_id": "c"'), ("empty", "")], "id string, value string")
    got = {}
    for r in P.payload_errors(lines, "id").collect():
        got.setdefault(r.id, []).append((r.section, r.pos, r.field, r.reason))
    want = {n: w for n, (_, w) in cases.items() if w} | {n: [("payload", None, None, "invalid_json")] for n in ("cut", "empty")}
    assert got == want
    ok, bad = P.checked_payloads(lines)
    assert {(r.candidate_id, r.mode) for r in ok.collect()} == {("c", "deep"), ("c", None)} and bad.count() == len(want)
    assert ok.filter("mode = 'deep'").first().identity.open_to_work.value is True
