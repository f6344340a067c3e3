"""Stored tables in buckets by key: a write touches only the buckets that its rows fall in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegraph.sources.scratch import Scratch


class Stored:
    """A table as Parquet, a folder for each bucket of its key.

    schema: the columns as DDL, without maps. keys: the natural key; of a table of children, the parent. Rows that are
    written are cast to the schema, columns that it lacks are left out, and null is a key like any other. An empty
    set of rows changes nothing. There is one writer at a time; what was read before a write is to be read again.

    A write is one job that puts its buckets beside the old ones and renames them when all are complete: one that fails
    before leaves the table as it was, and doing any write twice is doing it once. The renames of several buckets are
    not one transaction. A bucket with very many rows is written by several tasks.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], buckets: int = 256):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), list(keys), buckets
        self.fields = T._parse_datatype_string(schema).fields
        self.bucket = "bucket"
        while self.bucket in {f.name.lower() for f in self.fields}:
            self.bucket += "_"
        self.scratch = Scratch(spark, "stored")

    def read(self) -> DataFrame:
        return self._stored().drop(self.bucket)

    def overwrite(self, rows: DataFrame) -> None:
        """The whole table is replaced by rows that do not come from it."""
        self._write(self._placed(rows), "overwrite", "static")

    def insert_absent(self, rows: DataFrame, order: Sequence[str] = ()) -> None:
        """Rows whose key is not stored are added, the first of each key by order and then by all columns."""
        new = self.scratch.keep(self._one(self._placed(rows, order), order, F.min))
        self._write(self._without(new, self._stored(self._buckets(new))), "append")
        self.scratch.drop(new)

    def upsert(self, rows: DataFrame, order: Sequence[str] = ()) -> None:
        """Rows are added or take the place of those of equal key, the last of each key by order and then by all columns."""
        new = self.scratch.keep(self._one(self._placed(rows, order), order, F.max))
        old = self._without(self._stored(self._buckets(new)), new)
        self._write(old.unionByName(new), "overwrite")
        self.scratch.drop(new)

    def replace_children(self, rows: DataFrame, parents: DataFrame | None = None) -> None:
        """All rows of the parents that rows or parents (the key's columns) name give way to rows; parents without rows end with none."""
        new = self.scratch.keep(self._placed(rows))
        named = new.select(self.bucket, *self.keys)
        if parents is not None:
            types = {f.name: f.dataType for f in self.fields}
            given = parents.select(*(F.col(k).cast(types[k]).alias(k) for k in self.keys))
            named = named.unionByName(given.withColumn(self.bucket, self._place()))
        named = self.scratch.keep(named.distinct())
        touched = self._buckets(named)
        after = self._without(self._stored(touched), named).unionByName(new)
        emptied = set(touched) - set(self._buckets(after)) if parents is not None else ()
        self._write(after, "overwrite")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for b in emptied:  # an overwrite of partitions leaves those that get no row
            self.scratch.fs.delete(path(f"{self.folder}/{self.bucket}={b}"), True)
        self.scratch.drop(new, named)

    def _place(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame, order: Sequence[str] = ()) -> DataFrame:
        extra = [F.col(c).alias(f"{self.bucket}_order_{i}") for i, c in enumerate(order)]
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.fields), *extra).withColumn(self.bucket, self._place())

    def _one(self, placed: DataFrame, order: Sequence[str], pick) -> DataFrame:
        """One row of each key, by partial aggregates, so that a key with very many rows shrinks before the shuffle."""
        first = [f"{self.bucket}_order_{i}" for i in range(len(order))]
        rest = [f.name for f in self.fields if f.name not in self.keys]
        if not rest:
            return placed.select(self.bucket, *self.keys).distinct()
        best = placed.groupBy(self.bucket, *self.keys).agg(pick(F.struct(*first, *rest)).alias("best"))
        return best.select(self.bucket, *(F.col(f.name) if f.name in self.keys else F.col("best")[f.name].alias(f.name) for f in self.fields))

    def _buckets(self, placed: DataFrame) -> list[int]:
        return [r[0] for r in placed.select(self.bucket).distinct().collect()]  # at most self.buckets numbers

    def _stored(self, touched: Sequence[int] | None = None) -> DataFrame:
        df = self.spark.read.schema(T.StructType([*self.fields, T.StructField(self.bucket, T.IntegerType())])).parquet(self.folder)
        return df if touched is None else df.filter(F.col(self.bucket).isin(list(touched)))

    def _without(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        on = [self.bucket, *self.keys]
        given = others.select(*(F.col(c).alias(f"other_{i}") for i, c in enumerate(on))).distinct()
        same = [rows[c].eqNullSafe(given[f"other_{i}"]) for i, c in enumerate(on)]
        return rows.join(given, same, "left_anti")

    def _write(self, placed: DataFrame, mode: str, overwrites: str = "dynamic") -> None:
        rows = placed.select(*(f.name for f in self.fields), self.bucket).hint("rebalance", F.col(self.bucket))
        rows.write.mode(mode).option("partitionOverwriteMode", overwrites).partitionBy(self.bucket).parquet(self.folder)
