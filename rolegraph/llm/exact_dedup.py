"""Exact de-duplication with counting quotient filters.

Each task sorts the 64-bit fingerprints of its rows and packs them into counting quotient filters: the
high bits of a fingerprint (quotient) say where its run lies, the run holds the low bits (remainders)
in order, each with a count. Filters are cut into ranges of quotients, ranges are shuffled and merged
by their sorted remainders, which loses nothing. Fingerprints with a count above one send their rows
to a grouping by the text's bytes, so a collision of fingerprints never joins two texts.

Defined results: a null text is an empty text and empty texts are equal to each other; of rows that
repeat doc_id and text one stays; null doc_ids come after all others. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolegraph.llm.common import Scratch, key_runs, small_batches, table, tidy
from rolegraph.llm.decisions import decided_rows

#: Java's pattern of the white space that is replaced by one space.
SPACES = r"[\x20\x09-\x0D]+"
#: Fingerprints that a task packs into one filter.
FILTER_ROWS = 1 << 20
#: A fingerprint with more than one in HOT of all rows is spread over SALTS tasks.
HOT, SALTS = 512, 64


class CountingQuotientFilter:
    """Sorted fingerprints of 64 bits with counts: occupied bits by quotient, run-end bits, remainders and counts by slot."""

    def __init__(self, quotient_bits: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotient_bits, self.occupied, self.run_ends, self.remainders, self.counts = quotient_bits, occupied, run_ends, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """fingerprints: uint64 in any order; counts: of each, else 1."""
        order = np.argsort(fingerprints, kind="stable")
        f = fingerprints[order]
        c = np.ones(len(f), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.zeros(0, np.int64)
        f, c = f[first], np.add.reduceat(c, first) if len(f) else c
        bits = max(1, math.ceil(math.log2(len(f) + 1)))
        q = (f >> np.uint64(64 - bits)).astype(np.int64)
        occupied = np.zeros(1 << bits, bool)
        occupied[q] = True
        run_ends = np.r_[q[1:] != q[:-1], True] if len(q) else np.zeros(0, bool)
        return cls(bits, occupied, run_ends, f & np.uint64((1 << (64 - bits)) - 1), c)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in order, and their counts."""
        run = np.cumsum(np.r_[0, self.run_ends[:-1]]) if len(self.run_ends) else np.zeros(0, np.int64)
        q = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (q << np.uint64(64 - self.quotient_bits)) | self.remainders, self.counts

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        all_ = [x.entries() for x in (self, *others)]
        return self.of(np.concatenate([f for f, _ in all_]), np.concatenate([c for _, c in all_]))

    def pack(self) -> bytes:
        head = np.array([self.quotient_bits, len(self.remainders)], "<u8").tobytes()
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.run_ends).tobytes() + self.remainders.astype("<u8").tobytes() + self.counts.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, blob: bytes) -> CountingQuotientFilter:
        bits, n = map(int, np.frombuffer(blob, "<u8", 2))
        at, size = 16, ((1 << bits) + 7) // 8
        occupied = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=1 << bits).astype(bool)
        at, size = at + size, (n + 7) // 8
        ends = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=n).astype(bool)
        at += size
        return cls(bits, occupied, ends, np.frombuffer(blob, "<u8", n, at), np.frombuffer(blob, "<u4", n, at + 8 * n).astype(np.int64))


def repeated_fingerprints(rows: DataFrame, fingerprint: str = "fp", slice_bits: int | None = None) -> DataFrame:
    """Fingerprints (long) that occur more than once, as fp and n.

    slice_bits: a filter is cut into 2^slice_bits ranges; the default follows the session's shuffle
    partitions, so a range's share of the input falls as the cluster is set up for more data.
    """
    spark = rows.sparkSession
    small_batches(spark)
    bits = slice_bits if slice_bits is not None else max(4, math.ceil(math.log2(2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))))
    packed = pa.schema([("slice", pa.int32()), ("filter", pa.binary())])

    def pack(it):
        held, n = [], 0

        def flush():
            f = np.sort(np.concatenate(held))
            ids = (f >> np.uint64(64 - bits)).astype(np.int64)
            edges = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
            blobs = [CountingQuotientFilter.of(f[a:b] << np.uint64(bits)).pack() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], schema=packed)

        for b in it:
            if b.num_rows:
                held.append(np.asarray(b.column(0)).view(np.uint64))
                n += b.num_rows
            if n >= FILTER_ROWS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    out = pa.schema([("fp", pa.int64()), ("n", pa.int64())])

    def merge(it):
        for run in key_runs(it, "slice"):
            ids, blobs = run.column("slice").to_pylist(), run.column("filter").to_pylist()
            a = 0
            while a < len(ids):
                z = a
                while z < len(ids) and ids[z] == ids[a]:
                    z += 1
                f, c = CountingQuotientFilter.unpack(blobs[a]).merge(*map(CountingQuotientFilter.unpack, blobs[a + 1 : z])).entries()
                f = (f[c > 1] >> np.uint64(bits)) | np.uint64(ids[a] << (64 - bits))
                if len(f):
                    yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(c[c > 1], pa.int64())], schema=out)
                a = z

    filters = rows.select(fingerprint).mapInArrow(tidy(pack), "slice int, filter binary")
    return filters.repartition("slice").sortWithinPartitions("slice").mapInArrow(tidy(merge), "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("__text"))
    keyed = rows.select("doc_id", "__text", F.xxhash64("__text").alias("fp"))
    light = scratch.keep(keyed.select("doc_id", "fp", F.sha2(F.encode("__text", "UTF-8"), 256).alias("text_sha256")))
    repeated = scratch.keep(repeated_fingerprints(light))
    # At most HOT fingerprints can each hold more than one in HOT of the rows, so that list may be broadcast.
    hot = F.broadcast(repeated.filter(F.col("n") > light.count() / HOT).select("fp", F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.hash("doc_id"), F.lit(SALTS))).otherwise(0)
    each_salt = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    spread = lambda rows: rows.join(hot, "fp", "left").withColumn("__salt", salt).drop("__hot")
    copied = lambda rows: rows.join(hot, "fp", "left").withColumn("__salt", each_salt).drop("__hot")
    classes = (
        spread(keyed)
        .join(copied(repeated), ["fp", "__salt"], "left_semi")
        .groupBy("fp", "__text")  # compares the texts' bytes
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("fp", F.sha2(F.encode("__text", "UTF-8"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    classes, light = copied(scratch.keep(classes)), spread(light)
    keys = ["fp", "text_sha256", "__salt"]
    copy = F.row_number().over(Window.partitionBy("doc_id", *keys).orderBy("doc_id"))
    found = light.join(classes, keys).withColumn("__copy", copy).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1))
    alone = light.join(classes, keys, "left_anti").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return found.select(cols).unionByName(alone.select(cols))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows = exact_dedup(docs, id_col, text_col).filter("not kept or group_size > 1").select("doc_id", "text_sha256", "kept")
    marks = rows.groupBy(F.col("doc_id").alias("doc"), F.col("text_sha256").alias("sha")).agg(F.bool_or("kept").alias("first"), F.bool_or(~F.col("kept")).alias("some"))
    # A row that occurs once and stays needs no decision.
    decided = Scratch(docs.sparkSession, "exact-dedup").keep(marks.filter("some").select("doc", "sha", "first"))
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    return decided_rows(docs, decided, F.col(id_col).cast("long"), F.sha2(F.encode(text, "UTF-8"), 256))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AND row_number() OVER (PARTITION BY norm, doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
