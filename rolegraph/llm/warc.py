"""WARC archives written index first, and read back by coalesced byte ranges.

Each task appends records to archives of its own, one gzip member a record, and emits a row of the index
for each: file, offset, length, URL, digest and type. A reader picks rows of the index, sorts them by file
and offset, joins ranges that are close and reads each joined range once.

Files are opened with pyarrow's file systems, so the folder may be any that those and Spark both know. An
attempt of a task has archives of its own; only those of the attempt that Spark keeps are in the index.

Defined results: a null payload is an empty one; a null URL is left out; records with the same key and
payload that hold the smallest key are all responses; null keys come after all others.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.llm.common import Scratch, new_folder, small_batches, table, tidy, utf8

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: An archive is closed at this size.
FILE_BYTES = 256 << 20
#: Ranges that are at most GAP bytes apart are read as one, of at most READ bytes unless one record is longer.
GAP, READ = 64 << 10, 4 << 20
#: Bytes of archives that a task reads back.
TASK_READ = 8 << 20
KEY = "urn:record:"
INDEX = "key long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"
RECORD = "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def file_system(folder: str):
    """The pyarrow file system of a folder that Spark names, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def with_revisits(pages: DataFrame, key_col: str, url_col: str, payload_col: str, least: int = REVISIT_BYTES) -> DataFrame:
    """key, url, payload, digest, bytes, refers_to: refers_to is the key of the response that a revisit repeats."""
    scratch = Scratch(pages.sparkSession, "revisits")
    rows = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), utf8(payload_col).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.length("payload").cast("long")})
    # Repeated payloads are counted before the shuffle; only digests that occur twice join their rows.
    first = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    first = scratch.keep(first)
    light = rows.select("key", "digest").join(first, "digest").filter(~F.col("key").eqNullSafe(F.col("first")))
    revisits = scratch.keep(light.select("key", "digest", F.col("first").alias("refers_to")).distinct())
    return rows.alias("r").join(revisits.alias("v"), F.col("r.key").eqNullSafe(F.col("v.key")) & (F.col("r.digest") == F.col("v.digest")), "left").select("r.*", "refers_to")


def member(key: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has no payload; its header tells the full payload's size and digest."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{KEY}{'' if key is None else key}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{KEY}{'' if refers_to is None else refers_to}>"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of with_revisits() as archives in folder; returns the index."""
    small_batches(rows.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        task, out, name, at = TaskContext.get(), None, "", 0
        for b in it:
            index: list[tuple] = []
            for key, url, payload, digest, size, refers in zip(*(b.column(c).to_pylist() for c in ("key", "url", "payload", "digest", "bytes", "refers_to")), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, at = fs.open_output_stream(f"{path}/{name}", compression=None), 0
                m = member(key, url, payload, digest, size, refers, refers is not None)
                out.write(m)
                index.append((key, name, at, len(m), url, digest, "response" if refers is None else "revisit", refers))
                at += len(m)
            if index:
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                names = ["key", "file", "offset", "length", "url", "digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names=names)
        if out is not None:
            out.close()

    return rows.mapInArrow(tidy(run), INDEX)


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that the rows of an index name, read by coalesced ranges; the digest is of the payload as read."""
    small_batches(index.sparkSession)

    def joined(rows: list[tuple]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for r in rows:
            if held and (r[0] != held[0][0] or r[1] - (held[-1][1] + held[-1][2]) > GAP or r[1] + r[2] - held[0][1] > READ):
                yield held
                held = []
            held.append(r)
        if held:
            yield held

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        name, file = None, None
        for b in it:
            for held in joined(list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))):
                if held[0][0] != name:
                    name, file = held[0][0], fs.open_input_file(f"{path}/{held[0][0]}")
                start, end = held[0][1], held[-1][1] + held[-1][2]
                block = file.read_at(end - start, start)
                out = []
                for _, offset, length in held:
                    fields, body = parse(zlib.decompress(block[offset - start : offset - start + length], 31))
                    ids = [fields.get(f, "").removeprefix(f"<{KEY}").removesuffix(">") for f in ("WARC-Record-ID", "WARC-Refers-To")]
                    key, refers = (int(x) if x else None for x in ids)
                    url, revisit = fields.get("WARC-Target-URI"), fields["WARC-Type"] == "revisit"
                    url = url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    digest, size = (fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])) if revisit else (hashlib.sha256(body).hexdigest(), len(body))
                    out.append((key, url, fields["WARC-Type"], refers, size, digest, body if with_payload else None))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    # Tasks are dealt by the bytes that they read, not by those of the index.
    tasks = max(1, math.ceil((index.agg(F.sum("length")).first()[0] or 0) / TASK_READ))
    sorted_ = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return sorted_.mapInArrow(tidy(run), RECORD)


def op4_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    index = Scratch(spark, "warc-index").keep(write_archives(with_revisits(table(spark, sf_dir, "pages"), "page_id", "url", "html"), folder))
    return read_records(index, folder, with_payload=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT page_id, n, h, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""
