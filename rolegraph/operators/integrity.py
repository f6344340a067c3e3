"""The declared rules of the domain's tables (V1-V3), and one report of what breaks them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolegraph.sources.tables import SCHEMAS

_SHARE = "confidence BETWEEN 0 AND 1"
# Conditions on rows, unique keys and references of each table. A condition that is null holds.
ROW_RULES: dict[str, dict[str, str]] = {
    "job_postings": {"min_experience_nonnegative": "min_experience_years >= 0", "max_experience_nonnegative": "max_experience_years >= 0", "experience_range_valid": "max_experience_years >= min_experience_years"},
    "job_requirements": {"weight_nonnegative": "weight >= 0", "confidence_range": _SHARE},
    "search_queries": {"precision_level_range": "precision_level BETWEEN 1 AND 5", "result_count_nonnegative": "result_count >= 0"},
    "search_results": {"result_rank_positive": "result_rank >= 1"},
    "candidates": {"total_experience_nonnegative": "total_experience_months >= 0", "data_quality_score_range": "data_quality_score BETWEEN 0 AND 100"},
    "candidate_experiences": {"duration_months_nonnegative": "duration_months >= 0", "confidence_range": _SHARE, "sort_order_nonnegative": "sort_order >= 0", "date_range_valid": "end_date >= start_date"},
    "candidate_educations": {"start_year_range": "start_year BETWEEN 1900 AND 2100", "end_year_range": "end_year BETWEEN 1900 AND 2100", "year_range_valid": "end_year >= start_year", "confidence_range": _SHARE, "sort_order_nonnegative": "sort_order >= 0"},
    "candidate_skills": {"endorsement_count_nonnegative": "endorsement_count >= 0", "confidence_range": _SHARE},
    "candidate_certifications": {"date_range_valid": "expiration_date >= issue_date", "confidence_range": _SHARE},
    "candidate_languages": {"confidence_range": _SHARE},
    "candidate_matches": {"total_score_range": "total_score BETWEEN 0 AND 100"},
}
UNIQUE_KEYS: dict[str, dict[str, list[str]]] = {
    "search_queries": {"uq_search_query_job_key": ["job_id", "normalized_query_key"]},
    "search_results": {"uq_search_result_query_url": ["query_id", "normalized_url"]},
    "candidates": {"uq_candidate_profile_url": ["normalized_profile_url"]},
    "candidate_skills": {"uq_candidate_skill_source": ["candidate_id", "normalized_name", "source"]},
    "candidate_languages": {"uq_candidate_language": ["candidate_id", "language_normalized"]},
    "candidate_matches": {"uq_candidate_match_job_candidate": ["job_id", "candidate_id"]},
    "shortlist_entries": {"uq_shortlist_job_candidate": ["job_id", "candidate_id"]},
}
# Child table, column, parent table; the parent's key has the name in PRIMARY_KEYS.
REFERENCES: list[tuple[str, str, str]] = [
    ("job_requirements", "job_id", "job_postings"), ("search_queries", "job_id", "job_postings"), ("search_results", "query_id", "search_queries"), ("search_results", "candidate_id", "candidates"), ("search_results", "duplicate_of_id", "search_results"),
    ("candidate_experiences", "candidate_id", "candidates"), ("candidate_educations", "candidate_id", "candidates"), ("candidate_skills", "candidate_id", "candidates"), ("candidate_certifications", "candidate_id", "candidates"), ("candidate_languages", "candidate_id", "candidates"),
    ("candidate_enrichment_runs", "candidate_id", "candidates"), ("candidate_merge_audits", "target_id", "candidates"), ("candidate_matches", "job_id", "job_postings"), ("candidate_matches", "candidate_id", "candidates"), ("shortlist_entries", "job_id", "job_postings"), ("shortlist_entries", "candidate_id", "candidates"),
]
PRIMARY_KEYS = {"job_postings": "job_id", "search_queries": "query_id", "search_results": "result_id", "candidates": "candidate_id"}


def row_report(df: DataFrame, table: str) -> DataFrame:
    """V1: table_name, rule, n for each rule of the table, zeros included; one pass and one aggregate for all rules."""
    rules = ROW_RULES[table]
    one = df.agg(*(F.count_if(~F.expr(cond)).alias(name) for name, cond in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(table).alias("table_name"), F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules))).alias("x")).select("x.*")


def key_report(df: DataFrame, table: str, name: str, key: list[str]) -> DataFrame:
    """V2: table_name, rule, n: the rows of a key too many. A key with a null repeats nothing; counts are combined before the shuffle."""
    more = df.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("k"))
    return more.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n")).select(F.lit(table).alias("table_name"), F.lit(name).alias("rule"), "n")


def reference_report(child: DataFrame, table: str, column: str, parent: DataFrame, key: str) -> DataFrame:
    """V3: table_name, rule, n: the rows that name a parent that is not there.

    References are counted by value first, so that a value that many rows share meets the parents once.
    """
    named = child.dropna(subset=[column]).groupBy(F.col(column).alias("__k")).agg(F.count(F.lit(1)).alias("k"))
    lost = named.join(parent.select(F.col(key).alias("__k")), "__k", "left_anti")
    return lost.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).select(F.lit(table).alias("table_name"), F.lit(f"fk_{column}").alias("rule"), "n")


def report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """V1-V3: table_name, rule, n of every declared rule of the given tables (by name), zeros included.

    A column that a table lacks counts as null, which breaks no rule; references to a table not given are left out.
    """
    full = {t: df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in StructType.fromDDL(SCHEMAS[t]) if f.name not in df.columns}) for t, df in tables.items()}
    parts = [row_report(df, t) for t, df in full.items() if t in ROW_RULES]
    parts += [key_report(df, t, name, key) for t, df in full.items() for name, key in UNIQUE_KEYS.get(t, {}).items()]
    parts += [reference_report(full[t], t, c, full[parent], PRIMARY_KEYS[parent]) for t, c, parent in REFERENCES if t in full and parent in full]
    return reduce(DataFrame.unionByName, parts)
