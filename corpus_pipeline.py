"""The corpus pipeline: stages that each work on all that the one before kept.

Documents that the toxicity or the quality model rejects go; of equal texts one stays; of each group of
near-duplicates (five-word shingles, similarity 0.8 or more) one stays; what is left is packed into
sequences. All stages but the last return the columns of documents.

Defined results: a stage's docstring names those of its operator. Other columns than doc_id and text are passed on
by all stages but the last, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolegraph.llm import exact_dedup, near_dedup, packing, quality, toxicity
from rolegraph.llm.common import Scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, size=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.word_bpe_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_low_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack),
]
#: SQL cannot express the trained models; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the shared folder and read by the next."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES:
        docs, read = scratch.keep(stage(spark, docs, sf_dir)), before
        before = docs
        if read is not None:
            scratch.drop(read)
    return docs
