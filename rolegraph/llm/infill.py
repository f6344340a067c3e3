"""Fill-in-middle transformation: texts cut in prefix, middle and suffix, which are reordered between marks.

Cuts are chosen in units (lines or code points) and made in bytes; lengths are reported in code points. A sparse
exception index converts between the two: it holds only the multibyte characters, with their positions and the bytes
that they have beyond one, so an ASCII span converts by plain arithmetic and any other cut by one binary search. Texts
are indexed by segments of SEGMENT bytes, and of a long text only the segments that a cut falls in.

Defined results: a null or empty text has no units, stays plain and gives an empty output; a null id counts as an
empty one in the hash; rows with equal ids get equal cuts; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.llm.common import row_groups, small_batches, table, text_buffer, tidy

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEGMENT = 1 << 20
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Exceptions:
    """The multibyte characters of UTF-8 bytes that begin and end at a character."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        #: Excess bytes of all exceptions before each one, and of all.
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])
        self.chars = self.bytes - self.excess[:-1]

    def to_chars(self, cut: np.ndarray) -> np.ndarray:
        return cut - self.excess[np.searchsorted(self.bytes, cut)]

    def to_bytes(self, cut: np.ndarray) -> np.ndarray:
        return cut + self.excess[np.searchsorted(self.chars, cut)]


class Buffer:
    """Bytes of some rows, in segments that begin at a character; counts up to each segment, details of those asked for."""

    def __init__(self, data: np.ndarray):
        self.data = data
        starts = [0]
        while starts[-1] + SEGMENT < len(data):
            at = starts[-1] + SEGMENT
            while data[at] & 0xC0 == 0x80:  # at most three bytes back
                at -= 1
            starts.append(at)
        self.starts = np.array([*starts, len(data)], np.int64)
        spans = list(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True))
        self.lines_before = np.cumsum([0, *(int(np.count_nonzero(data[a:b] == 10)) for a, b in spans)])
        self.chars_before = np.cumsum([0, *(b - a - int(np.count_nonzero((data[a:b] & 0xC0) == 0x80)) for a, b in spans)])

    def _by_segment(self, values: np.ndarray, before: np.ndarray, side: str) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Which values fall in a segment, the segment, and its bytes; before: the value at each segment's start."""
        of = np.clip(np.searchsorted(before, values, side) - 1, 0, len(self.starts) - 2)
        for s in np.unique(of).tolist():
            yield np.flatnonzero(of == s), s, self.data[self.starts[s] : self.starts[s + 1]]

    def to_chars(self, cut: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cut), np.int64)
        for own, s, data in self._by_segment(cut, self.starts, "right"):
            out[own] = self.chars_before[s] + Exceptions(data).to_chars(cut[own] - self.starts[s])
        return out

    def to_bytes(self, cut: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cut), np.int64)
        for own, s, data in self._by_segment(cut, self.chars_before, "right"):
            out[own] = self.starts[s] + Exceptions(data).to_bytes(cut[own] - self.chars_before[s])
        return out

    def lines(self, cut: np.ndarray) -> np.ndarray:
        """Line ends before each byte."""
        out = np.zeros(len(cut), np.int64)
        for own, s, data in self._by_segment(cut, self.starts, "right"):
            out[own] = self.lines_before[s] + np.searchsorted(np.flatnonzero(data == 10), cut[own] - self.starts[s])
        return out

    def after_line(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th line end of the buffer, counted from 1."""
        out = np.zeros(len(k), np.int64)
        for own, s, data in self._by_segment(k, self.lines_before, "left"):
            out[own] = self.starts[s] + np.flatnonzero(data == 10)[k[own] - self.lines_before[s] - 1] + 1
        return out


def units(buffer: Buffer, begin: np.ndarray, end: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """How many units each row has, and how many lie in the buffer before it."""
    if unit == "char":
        before = buffer.to_chars(begin)
        return buffer.to_chars(end) - before, before
    before = buffer.lines(begin)
    open_end = (end > begin) & (buffer.data[np.maximum(end - 1, 0)] != 10) if len(buffer.data) else np.zeros(len(begin), bool)
    return buffer.lines(end) - before + open_end, before


def cut_bytes(buffer: Buffer, begin: np.ndarray, end: np.ndarray, n: np.ndarray, before: np.ndarray, k: np.ndarray, unit: str) -> np.ndarray:
    """The byte after the first k of a row's n units."""
    out = np.where(k == 0, begin, end)
    own = np.flatnonzero((k > 0) & (k < n))
    if len(own):
        out[own] = buffer.to_bytes(before[own] + k[own]) if unit == "char" else buffer.after_line(before[own] + k[own])
    return out


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[4 * i : 4 * i + 4], "big") for i in range(4))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", percent: int = 100, spm_percent: int = 50, seed: int = 7) -> DataFrame:
    """Columns COLUMNS: a row for each text, with its output.

    unit: line or char. percent of the texts are cut, spm_percent of those put the suffix first; which ones, and
    where, follows from the seed and the id alone.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit is line or char")
    small_batches(docs.sparkSession)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    names, types = [c.split()[0] for c in COLUMNS.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = b.column(0).to_pylist()
            data, offs = text_buffer(b.column(1))
            for i, j in row_groups(offs):
                own = Buffer(data[offs[i] : offs[j]])
                begin, end = offs[i:j] - offs[i], offs[i + 1 : j + 1] - offs[i]
                n, before = units(own, begin, end, unit)
                h = np.array([draws(seed, x) for x in ids[i:j]], np.int64)
                k = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                a, z = (cut_bytes(own, begin, end, n, before, k[:, c], unit) for c in (0, 1))
                chars = [own.to_chars(x) for x in (begin, a, z)]
                forms, outputs = [], []
                for r, (s, p, m, e) in enumerate(zip(begin.tolist(), a.tolist(), z.tolist(), end.tolist(), strict=True)):
                    text = own.data[s:e].tobytes()
                    if not text or h[r, 2] % 100 >= percent or any(x in text for x in marks):
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    prefix, middle, suffix = text[: p - s], text[p - s : m - s], text[m - s :]
                    forms.append("spm" if h[r, 3] % 100 < spm_percent else "psm")
                    first = (marks[1], suffix, marks[0], prefix) if forms[-1] == "spm" else (marks[0], prefix, marks[1], suffix)
                    outputs.append(b"".join([*first, marks[2], middle]))
                plain = np.array([f == "plain" for f in forms])
                columns = [ids[i:j], n, forms, pa.array(chars[1] - chars[0], mask=plain), pa.array(chars[2] - chars[1], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(tidy(run), COLUMNS)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text from an output and its form. No text that was cut holds a mark, so the first of each is the one set."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        size, p, q = len(first), F.locate(second, output), F.locate(MIDDLE, output)
        return F.substr(output, F.lit(size + 1), p - size - 1), F.substr(output, p + len(second), q - p - len(second)), F.substr(output, q + len(MIDDLE))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    out = transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


OP13_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents
), l AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM t
), k AS (
  SELECT doc_id, text, lines, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS z,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM l
), p AS (
  SELECT doc_id, text, n, form, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:z], '') AS middle, array_to_string(lines[z + 1:n], '') AS suffix FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
