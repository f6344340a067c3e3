"""Decisions on rows, put into effect without moving the rows that they don't concern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm.common import unused

#: Buckets of the filter before a join by id: a table of at most so many numbers, so it may be broadcast.
BUCKETS = 1 << 20


def bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def decided_rows(docs: DataFrame, decided: DataFrame, doc: Column, sha: Column) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names.

    decided: doc, sha, first; a table that is read several times. Rows of docs with that doc (null is a value)
    and sha go, but of those marked `first` one stays. Rows whose doc falls in no bucket of a decided one are
    passed on as they are; only the rest is shuffled.
    """
    d, s, b = unused(docs, "__doc", "__sha", "__bucket")
    own = docs.withColumns({d: doc}).withColumns({b: bucket(d)})
    buckets = F.broadcast(decided.select(bucket("doc").alias(b)).distinct())  # at most BUCKETS rows
    here, columns = own.join(buckets, b, "left_semi").withColumns({s: sha}), [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]

    def among(some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("doc").alias("d"), F.col("sha").alias("s"))
        return here.alias("x").join(some.alias("y"), F.col(f"x.{d}").eqNullSafe(F.col("y.d")) & (F.col(f"x.{s}") == F.col("y.s")), how)

    out = own.join(buckets, b, "left_anti").select(columns).unionByName(among(decided, "left_anti").select(columns))
    repeated = decided.filter("first")
    if not repeated.isEmpty():
        out = out.unionByName(among(repeated, "left_semi").dropDuplicates([d, s]).select(columns))
    return out
