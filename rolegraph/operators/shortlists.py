"""Shortlists and status machines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.sources.tables import upsert

# Allowed status changes by machine; staying is always allowed.
TRANSITIONS = {
    "job": {"draft": "parsed archived", "parsed": "sourcing archived draft", "sourcing": "completed archived parsed", "completed": "archived sourcing", "archived": "draft"},
    "candidate": {
        "discovered": "queued partial unavailable failed",
        "queued": "discovered scraped partial unavailable failed",
        "scraped": "queued partial unavailable failed",
        "partial": "queued scraped unavailable failed",
        "unavailable": "queued discovered",
        "failed": "queued discovered",
    },
    "shortlist": {"shortlisted": "reviewed rejected contacted", "reviewed": "shortlisted rejected contacted", "contacted": "reviewed rejected", "rejected": "shortlisted reviewed"},
}


def add_or_update(entries: DataFrame, new: DataFrame) -> DataFrame:
    """By job and candidate."""
    return upsert(entries, new, ["job_id", "candidate_id"])


def updated(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes: job_id, candidate_id, new_status, note_set, new_note; a note changes only where it is set."""
    c = changes.select("job_id", "candidate_id", "new_status", "note_set", "new_note")
    rows = entries.join(c, ["job_id", "candidate_id"], "left")
    return rows.withColumns({"status": F.coalesce("new_status", "status"), "note": F.when(F.col("note_set"), F.col("new_note")).otherwise(F.col("note"))}).drop("new_status", "note_set", "new_note")


def checked(changes: DataFrame, machine: str) -> DataFrame:
    """Changes (from_status, to_status) with allowed."""
    spark = changes.sparkSession
    rows = [(a, b) for a, to in TRANSITIONS[machine].items() for b in to.split()]
    table = F.broadcast(spark.createDataFrame(rows, "from_status string, to_status string").withColumn("listed", F.lit(True)))
    return changes.join(table, ["from_status", "to_status"], "left").withColumn("allowed", F.coalesce("listed", F.col("from_status") == F.col("to_status"))).drop("listed")


# What listings may be sorted by.
SORTS = ("created_at", "updated_at", "total_score", "full_name", "status")


def listing(entries: DataFrame, candidates: DataFrame, matches: DataFrame, statuses: Sequence[str] | None = None, min_score: float | None = None, city: str | None = None, text: str | None = None, source: str | None = None) -> DataFrame:
    """Entries with their candidate and, where there is one, the match's score; a minimum drops entries without a score. relational.page_each sorts by one of SORTS and gives a page of each job and its counts."""
    rows = entries.join(candidates, "candidate_id").join(matches.select("job_id", "candidate_id", "total_score"), ["job_id", "candidate_id"], "left")
    rows = rows if statuses is None else rows.filter(F.col("status").isin(list(statuses)))
    rows = rows if min_score is None else rows.filter(F.col("total_score") >= min_score)
    for c, v in (("city", city), ("source", source)):
        rows = rows if v is None else rows.filter(F.lower(c) == v.lower())
    return rows if text is None else rows.filter(F.contains(F.lower(F.concat_ws("\n", "full_name", "headline", "note")), F.lit(text.lower())))


def matches_of_jobs(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, candidate_id, total_score of the given jobs, a row for each candidate; a job's scores are never one value."""
    return matches.join(jobs.select("job_id").distinct(), "job_id", "left_semi").select("job_id", "candidate_id", "total_score")
