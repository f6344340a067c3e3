"""Shared pieces of the training-data operators: tables, cluster folders, Arrow buffers, hashed words.

The Python side works on the buffers of Arrow batches with numpy, a bounded number of bytes at a
time, so a task's memory does not depend on the number of rows that it reads.
"""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on.
STEP_BYTES = 1 << 18
#: Rows and bytes of an Arrow batch between the JVM and Python.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20

#: Bytes that a task should read at least, where a stage is known to read little.
TASK_BYTES = 4 << 20

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """A driver table; also sets the size of Arrow batches, which bounds a Python worker's memory."""
    small_batches(spark)
    return spark.read.options(**options).parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or an own one on a single machine where that is unset."""
    sc = spark.sparkContext
    if given := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return given.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder for one run under the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _, fs, at = _file(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    _, fs, at = _file(spark, path)
    fs.delete(at, True)


class Scratch:
    """Intermediate tables of one run, as Parquet in a folder of their own that all machines share.

    A table is computed once, survives lost executors and ends the lineage. It is read in as many partitions as
    its bytes need, and its size is known to the planner. Tables that are no longer needed can be dropped; what
    the result still reads goes when the application ends.
    """

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.folder, self.number, self.paths = spark, new_folder(spark, kind), 0, {}

    def keep(self, df: DataFrame, stage_bytes: float | None = None, group_rows: int | None = None) -> DataFrame:
        """df written and read again. stage_bytes: about how much the last stage of df reads, where that is known to be little.

        group_rows: how many rows a row group has at most, for rows of megabytes. Parquet looks at a group's bytes after
        100 rows only, and Spark decodes up to 4,096 rows of a group at once.
        """
        self.number += 1
        path = f"{self.folder}/{self.number}"
        writer = fitted(df, stage_bytes).write
        (writer if group_rows is None else writer.option("parquet.block.row.count.limit", group_rows)).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that keep() gave and that nothing reads any more."""
        for f in frames:
            delete(self.spark, self.paths.pop(id(f))[1])


def fitted(df: DataFrame, stage_bytes: float | None) -> DataFrame:
    """df in no more partitions than tasks of TASK_BYTES need; rows don't move between machines for that."""
    return df if stage_bytes is None else df.coalesce(max(1, math.ceil(stage_bytes / TASK_BYTES)))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and where each row begins; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = a.buffers()
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(offs), np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def row_groups(offs: np.ndarray, target: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about target bytes each; a longer row is alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + target, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, STEP_BYTES + (1 << 16))
        up, down = np.full(m, _P, np.uint64), np.full(m, _INV, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def byte_values(fold_case: bool = True) -> np.ndarray:
    """A fixed random 64-bit value for each byte; with fold_case A-Z have those of a-z."""
    v = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if fold_case:
        v[65:91] = v[97:123]
    return v


class Words:
    """Words of a block of rows: where they begin and end, their hashes, and the words of each row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, separators: np.ndarray, values: np.ndarray, affixes: tuple[int, ...] = ()):
        """affixes: k for the first k bytes of a word, -k for the last k; hashes of words that have as many."""
        starts, ends, hashes, parts = [], [], [], {k: [] for k in affixes}
        begins = np.zeros(len(data) + 1, bool)
        begins[offs[:-1]] = True
        lo = 0
        while lo < len(data):
            hi = min(len(data), lo + STEP_BYTES)
            while hi < len(data) and not (begins[hi] or separators[data[hi]]):  # a word is never cut
                hi += 1
            d = data[lo:hi]
            inside = ~separators[d]
            first, last = inside.copy(), inside.copy()
            border = begins[lo + 1 : hi]
            first[1:] &= ~inside[:-1] | border
            last[:-1] &= ~inside[1:] | border
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            up, down = _pow(len(d))
            sums = np.zeros(len(d) + 1, np.uint64)
            np.cumsum(values[d] * up[: len(d)], out=sums[1:])
            hashes.append(mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
            for k in affixes:
                a, b = (s, np.minimum(s + k, e)) if k > 0 else (np.maximum(e + k, s), e)
                h = mix64((sums[b] - sums[a]) * down[a] + np.uint64(abs(k) * 1000003 + (k < 0) * 7919))
                h[e - s < abs(k)] = 0
                parts[k].append(h)
            starts.append(s + lo)
            ends.append(e + lo)
            lo = hi
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.starts, self.ends, self.hashes = join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)
        self.parts = {k: join(v, np.uint64) for k, v in parts.items()}
        #: The words of row i are those from rows[i] to rows[i + 1].
        self.rows = np.searchsorted(self.starts, offs)


def tidy(run):
    """For mapInArrow: run, and at the task's end give freed memory back, since Python workers outlive tasks."""

    def wrapped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def batches(fn, schema: pa.Schema):
    """For mapInArrow: fn(batch) gives the columns of the schema for each batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) if not isinstance(v, pa.Array | pa.ChunkedArray) else v.cast(t) for v, t in zip(fn(b), schema.types, strict=True)], schema=schema)

    return tidy(run)


def key_runs(it: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole runs of equal keys from sorted batches, several small runs at a time."""
    kept: list[pa.RecordBatch] = []
    for b in it:
        if not b.num_rows:
            continue
        k = b.column(key)
        last = k[b.num_rows - 1]
        if k[0].equals(last) and kept and kept[-1].column(key)[kept[-1].num_rows - 1].equals(last):
            kept.append(b)
            continue
        v = np.asarray(k)
        at = int(np.flatnonzero(v != v[-1])[-1]) + 1 if (v != v[-1]).any() else 0
        if at == 0:
            if kept:
                yield pa.Table.from_batches(kept)
            kept = [b]
            continue
        yield pa.Table.from_batches([*kept, b.slice(0, at)])
        kept = [b.slice(at)]
    if kept:
        yield pa.Table.from_batches(kept)


def utf8(column: str):
    """A text column as bytes, null as empty."""
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")
