"""Query names, their functions and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolegraph.plans import enriching, importing, listing, matchlists, merging, records, storing  # noqa: F401  they register their queries
from rolegraph.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["match_top_candidates"](spark, sf_dir)
