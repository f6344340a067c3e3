"""Typed tables, set-level writes, exports."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "job_postings": "job_id string, title string, company string, description_raw string, description_clean string, location_raw string, city string, country string, source string, source_url string, min_experience_years double, max_experience_years double, status string, created_at timestamp",
    "job_requirements": "job_id string, type string, raw_value string, normalized_value string, importance string, weight double, confidence double, evidence_text string, evidence_start int, evidence_end int, seq long",
    "search_queries": "query_id string, job_id string, query_text string, normalized_query_key string, query_type string, language string, precision_level int, status string, result_count int, created_at timestamp, executed_at timestamp",
    "search_results": "result_id string, query_id string, source_url string, normalized_url string, source_domain string, candidate_profile_slug string, title string, snippet string, displayed_name string, displayed_headline string, displayed_location string, result_rank int, is_duplicate boolean, duplicate_of_id string, candidate_id string, discovered_at timestamp",
    "candidates": "candidate_id string, primary_profile_url string, normalized_profile_url string, profile_slug string, source string, full_name string, headline string, about string, discovery_title string, discovery_snippet string, location_raw string, city string, country string, current_title string, current_company string, total_experience_months int, open_to_work boolean, profile_status string, data_quality_score double, last_scraped_at timestamp, created_at timestamp, updated_at timestamp",
    "candidate_experiences": "candidate_id string, external_key string, position_title_raw string, position_title_normalized string, company_name string, company_url string, location string, start_date date, end_date date, is_current boolean, duration_months int, description string, skills_detected array<string>, industry_detected string, confidence double, source string, sort_order int",
    "candidate_educations": "candidate_id string, external_key string, institution_name string, degree string, field_of_study string, field_of_study_normalized string, start_year int, end_year int, confidence double, source string, sort_order int",
    "candidate_skills": "candidate_id string, raw_name string, normalized_name string, category string, endorsement_count int, source string, confidence double",
    "candidate_certifications": "candidate_id string, external_key string, name string, issuer string, issue_date date, expiration_date date, credential_id string, credential_url string, confidence double, source string",
    "candidate_languages": "candidate_id string, language string, language_normalized string, proficiency string, confidence double, source string",
    "candidate_enrichment_runs": "run_id string, candidate_id string, provider string, mode string, import_mode string, status string, created_at timestamp",
    "candidate_merge_audits": "cluster_id string, target_id string, strategy string, merged_fields string, conflicts array<string>",
    "candidate_matches": "job_id string, candidate_id string, total_score double, explanation string, version string, created_at timestamp",
    "shortlist_entries": "job_id string, candidate_id string, status string, note string, created_at timestamp",
}
#: Search results as they are imported.
RESULT = "url string, title string, snippet string, displayed_name string, displayed_headline string, displayed_location string, rank int"
_field = "struct<value: string, source: string, confidence: double, evidence: string>"
PAYLOAD = (
    "payload_id string, candidate_id string, provider string, mode string, import_mode string, identity_update_strategy string, "
    f"identity struct<headline: {_field}, full_name: {_field}, about: {_field}, location_raw: {_field}, city: {_field}, country: {_field}, current_title: {_field}, current_company: {_field}, open_to_work: struct<value: boolean, source: string, confidence: double, evidence: string>>, "
    "experiences array<struct<external_key: string, position_title_raw: string, company_name: string, company_url: string, employment_type: string, location: string, start_date: date, end_date: date, is_current: boolean, duration_months: int, description: string, skills_detected: array<string>, industry_detected: string, confidence: double, source: string, sort_order: int>>, "
    "educations array<struct<external_key: string, institution_name: string, degree: string, field_of_study: string, start_year: int, end_year: int, grade: string, description: string, source: string, confidence: double, sort_order: int>>, "
    "skills array<struct<raw_name: string, category: string, endorsement_count: int, source: string, confidence: double>>, "
    "certifications array<struct<external_key: string, name: string, issuer: string, issue_date: date, expiration_date: date, credential_id: string, credential_url: string, source: string, confidence: double>>, "
    "languages array<struct<language: string, proficiency: string, source: string, confidence: double>>, sections_present array<string>, parser_version string, warnings array<string>, is_partial boolean"
)


def kept(df: DataFrame) -> DataFrame:
    """df computed once and written to the folder that all machines share (spark.checkpoint.dir); a local session without one takes its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A domain table with its declared schema."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}")


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str, lowest: int, highest: int, partitions: int, **options: str) -> DataFrame:
    """A table of a database, read in ranges of a numeric key; the user supplies the driver."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=lowest, upperBound=highest, numPartitions=partitions, **options).load()


def json_results(lines: DataFrame, column: str = "value", most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Result records of JSON arrays (query_id, column), and imports that are not valid or too large with a reason."""
    parsed = lines.withColumn("r", F.from_json(column, f"array<struct<{RESULT.replace(' string', ': string').replace(' int', ': int')}>>"))
    reason = F.when(F.col("r").isNull(), "invalid_json").when(F.size("r") > most, "too_many_results")
    parsed = parsed.withColumn("reject_reason", reason)
    return parsed.filter("reject_reason is null").select("query_id", F.posexplode("r").alias("pos", "x")).select("query_id", "pos", "x.*"), parsed.filter("reject_reason is not null").select("query_id", "reject_reason")


def url_records(lines: DataFrame, column: str = "value", most: int = 500) -> tuple[DataFrame, DataFrame]:
    """S3: a record with only a URL for each line of an import (query_id, column), and imports without a line or with too many, with a reason."""
    rows = lines.withColumn("r", F.filter(F.split(column, r"\r?\n"), lambda x: F.trim(x) != ""))
    rows = rows.withColumn("reject_reason", F.when(F.coalesce(F.size("r"), F.lit(0)) < 1, "empty_import").when(F.size("r") > most, "too_many_results"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(RESULT).fields if f.name != "url"]
    return rows.filter("reject_reason is null").select("query_id", F.posexplode("r").alias("pos", "url")).select("query_id", "pos", "url", *nothing), rows.filter("reject_reason is not null").select("query_id", "reject_reason")


def payloads(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Enrichment payloads, and lines that do not parse."""
    rows = lines.withColumn("p", F.from_json(column, f"struct<{_ddl(PAYLOAD)}>", {"mode": "PERMISSIVE"}))
    bad = F.col("p").isNull() | F.col("p.candidate_id").isNull()
    return rows.filter(~bad).select("p.*"), rows.filter(bad).select(column)


def _ddl(columns: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T._parse_datatype_string(columns).fields)


def section(payloads_: DataFrame, name: str) -> DataFrame:
    """A child collection as rows with pos."""
    return payloads_.select("payload_id", "candidate_id", F.posexplode(name).alias("pos", "x")).select("payload_id", "candidate_id", "pos", "x.*")


def guarded(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(c.rlike(r"^[=+@\-]"), F.concat(F.lit("'"), c)).otherwise(c)


# The export's columns in order, and the listing's columns that they show.
EXPORT = {"full_name": "candidate_name", "headline": "headline", "current_title": "current_title", "current_company": "current_company", "city": "city", "country": "country", "primary_profile_url": "profile_url", "total_score": "match_score", "status": "shortlist_status", "note": "recruiter_note", "created_at": "created_at", "updated_at": "updated_at"}
BYTE_ORDER_MARK = "\ufeff"


def shortlist_export(entries: DataFrame, most: int | None = None) -> DataFrame:
    """job_id, n and the export's columns: guarded text, ISO times, blank for nulls, each job's oldest entry first; all rows, or at most `most` a job (10,000 in the reference's request).

    Columns that the listing lacks are blank.
    """
    rows = entries.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy("created_at", "candidate_id")))
    if most is not None:
        rows = rows.filter(F.col("n") <= most)

    def shown(c: str) -> Column:
        if c not in entries.columns:
            return F.lit("")
        if c in ("created_at", "updated_at"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
        return F.col(c).cast("string") if c in ("total_score", "status") else guarded(F.col(c))

    return rows.select("job_id", "n", *(F.coalesce(shown(c), F.lit("")).alias(name) for c, name in EXPORT.items()))


def write_csv(export: DataFrame, folder: str) -> None:
    """CSV files by job in the order of n, each with a header that begins with a byte-order mark.

    A job's rows are dealt by ranges of n, so that a large job is several files and no task's sort is larger than
    its share.
    """
    first, *rest = EXPORT.values()
    rows = export.repartitionByRange("job_id", "n").sortWithinPartitions("job_id", "n")
    rows.select("job_id", F.col(first).alias(BYTE_ORDER_MARK + first), *rest).write.mode("overwrite").partitionBy("job_id").option("header", True).csv(folder)


def absent(rows: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose natural key is not stored."""
    return rows.join(stored.select(*keys), list(keys), "left_anti").select(rows.columns)


def upsert(stored: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows, with those of equal key replaced."""
    return absent(stored, rows, keys).unionByName(rows.select(stored.columns))


def replace_children(stored: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that rows name are replaced; doing it twice changes nothing."""
    return upsert(stored, rows, [parent])


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, n."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()))
