"""Phrases of large dictionaries, declared rules, single results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rolegraph.operators import extraction, imports, integrity


def plain_hits(key, phrases):
    """The phrases of one dictionary in a key by a plain loop: earliest, longest of those, no overlaps."""
    out, i = [], 0
    words = re.compile(r"\w")
    while i < len(key):
        found = [p for n in range(min(len(key) - i, 60), 0, -1) if (p := key[i : i + n]) in phrases and not (i and words.match(key[i - 1])) and not (i + n < len(key) and words.match(key[i + n]))]
        if found:
            out.append((found[0], phrases[found[0]]))
        i += len(found[0]) if found else 1
    return out


def test_phrases_of_a_large_dictionary_equal_a_plain_loop(spark):
    rng = random.Random(7)
    words = ["a", "b", "ab", "c++", "c", ".net", "asp.net", "node.js", "node", "iğ", "é", "x-y", "x"]
    some = {" ".join(rng.choices(words, k=rng.randint(1, 4))): f"v{n}" for n in range(400)}
    big = {f"filler {n} w{n % 97}": "f" for n in range(100_000)}
    kinds = {"one": some | big, "two": {"a b": "p", "b a": "q", "a": "r", "+": "plus", "filler 5": "short"}}
    keys = ["", " ", "asp.net", "a b a b a", "filler 5 w5", "c+++ c++", "a" * 5000, "a b " * 2000, *(rng.choice(["", ",", " ("]).join(rng.choices([*words, " ", "filler 77 w77", "filler 78"], k=rng.randint(1, 25))) for _ in range(300))]
    rows = spark.createDataFrame([*enumerate(keys), (9999, None)], "id int, key string")
    got = {}
    for r in extraction.phrase_hits(rows, ["id"], kinds).orderBy("id", "kind", "match").collect():
        got.setdefault((r.id, r.kind), []).append((r.phrase, r.value))
    for i, key in enumerate(keys):
        for kind, phrases in kinds.items():
            assert got.get((i, kind), []) == plain_hits(key, phrases), (key[:80], kind)
    assert 9999 not in {i for i, _ in got}


def test_phrases_do_not_depend_on_how_the_dictionary_is_sent(spark):
    rows = spark.createDataFrame([(1, "senior python developer, python"), (1, "python")], "id int, key string").withColumn("row", F.monotonically_increasing_id())
    kinds = {"k": {"python": "python", "python developer": "dev"}}
    a, b = (sorted(map(tuple, extraction.phrase_hits(rows, ["id", "row"], kinds, most_broadcast=n).select("kind", "match", "phrase").collect())) for n in (0, 100))
    assert a == b == [("k", 0, "python"), ("k", 0, "python developer"), ("k", 1, "python")]


@pytest.mark.parametrize("rows", [[], [("1", "u", -1, 101.0), ("2", "u", None, None), ("3", None, 5, 50.0), ("4", None, 5, 50.0)]])
def test_integrity_report(spark, rows):
    candidates = spark.createDataFrame(rows, "candidate_id string, normalized_profile_url string, total_experience_months int, data_quality_score double")
    skills = spark.createDataFrame([(c, "x", "s") for c in ("1", "1", "9", None)] if rows else [], "candidate_id string, normalized_name string, source string")
    got = {(r.table_name, r.rule): r.n for r in integrity.report({"candidates": candidates, "candidate_skills": skills}).collect()}
    want = {("candidates", "total_experience_nonnegative"): 1, ("candidates", "data_quality_score_range"): 1, ("candidates", "uq_candidate_profile_url"): 1, ("candidate_skills", "uq_candidate_skill_source"): 1, ("candidate_skills", "fk_candidate_id"): 1}
    assert {k: n for k, n in got.items() if n} == (want if rows else {})
    assert ("candidate_skills", "confidence_range") in got


RESULT = "result_id int, job_id int, normalized_url string, candidate_profile_slug string, displayed_name string, displayed_headline string, displayed_location string, title string, snippet string, candidate_id int, source_url string, name string, e string"


def test_single_results_and_new_candidates(spark):
    person = lambda i, url, linked=None: (i, 1, url, None, "Ada Lovelace", None, None, "t", "s", linked, url, "n", "e")
    rows = spark.createDataFrame([person(1, "https://a.example/x", 7), person(2, "https://b.example/x"), person(3, "https://b.example/x"), person(4, "https://c.example/x"), person(5, None)], RESULT)
    people = spark.createDataFrame([(70, "https://c.example/x", None, 1)], "candidate_id int, normalized_profile_url string, profile_slug string, created_at int")
    wanted = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5, 6)], "result_id int")
    got = {r.result_id: (r.action, r.candidate_id, r.leader_id, r.confidence, r.error) for r in imports.discover_single(rows, people, wanted).collect()}
    assert got == {
        1: ("linked_existing", 7, None, 1.0, None), 2: ("created", None, 2, 0.7, None), 3: ("linked_existing", None, 2, 0.7, None), 4: ("linked_existing", 70, None, 0.7, None),
        5: (None, None, None, None, "search_result_not_eligible"), 6: (None, None, None, None, "search_result_not_found"),
    }
    made = imports.new_candidates(imports.discover(rows.filter("candidate_id is null"), people), rows).collect()
    assert [(r.result_id, r.full_name, r.data_quality_score) for r in made] == [(2, "Ada Lovelace", 35.0)]
    assert imports.new_candidates(imports.discover(rows.limit(0), people), rows.limit(0)).count() == 0
