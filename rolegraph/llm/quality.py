"""Quality classifier: a byte-level convolutional network in numpy.

A text is covered by overlapping chunks of bytes. Each byte has a learned vector, learned filters run over
the bytes of a chunk, the largest response of each filter is kept, a hidden layer follows, and the mean of
the chunks' hidden layers gives one probability. All layers are trained here, from document labels.

Defined results: null and empty texts count as one chunk of padding; a null doc_id is not held out; without
examples of both labels every score is 1, so nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegraph.llm.common import row_groups, small_batches, table, text_buffer, tidy, unused
from rolegraph.llm.labelled import remainder, sample

#: Examples of each label, and the longest text among them.
MOST, MOST_CHARS = {1: 3000, 0: 2000}, 20_000
CHUNK, STEP = 256, 192
#: Sizes: of a byte's vector, a filter's width and stride in bytes, number of filters, hidden layer.
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 4, 8, 2, 32, 16
PLACES = (CHUNK - WIDTH) // STRIDE + 1
#: Chunks that are scored at once.
AT_ONCE = 2048
#: A document is rejected below this score.
ACCEPT = 0.3


def chunk_places(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each chunk of all rows begins, and its row; a row without bytes has one chunk."""
    n = np.maximum(1, -(-(np.diff(offs) - (CHUNK - STEP)) // STEP))
    row = np.repeat(np.arange(len(n)), n)
    return offs[:-1][row] + STEP * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)), row


def chunk_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Chunks as a matrix of byte values plus one (0: padding, from the row's end on)."""
    if not len(data):
        return np.zeros((len(start), CHUNK), np.int64)
    at = start[:, None] + np.arange(CHUNK)
    return np.where(at < end[:, None], data[np.minimum(at, len(data) - 1)].astype(np.int64) + 1, 0)


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of some rows, and the row of each."""
    start, row = chunk_places(offs)
    return chunk_bytes(data, start, offs[1:][row]), row


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "embed": r.normal(0, 0.5, (257, EMBED)).astype(f),
            "filters": r.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f),
            "hidden": r.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)).astype(f),
            "hidden_bias": np.zeros(HIDDEN, f),
            "out": r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(f),
            "out_bias": np.zeros(1, f),
        }

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest response of each filter in each chunk, and where it lies."""
        most, where = [], []
        for i in range(0, len(x), 64):
            e = np.ascontiguousarray(self.p["embed"][x[i : i + 64]]).reshape(len(x[i : i + 64]), -1)
            s = e.strides[1]
            w = as_strided(e, (len(e), PLACES, WIDTH * EMBED), (e.strides[0], STRIDE * EMBED * s, s)).reshape(-1, WIDTH * EMBED)
            r = (w @ self.p["filters"]).reshape(len(e), PLACES, FILTERS)
            most.append(r.max(1))
            if places:
                where.append(r.argmax(1))
        cat = lambda v, t: np.concatenate(v) if v else np.zeros((0, FILTERS), t)
        return cat(most, np.float32), cat(where, np.int64) if places else None

    def hidden(self, x: np.ndarray, places: bool = False) -> tuple:
        """What each chunk gives, and what led there."""
        most, where = self.pooled(x, places)
        pre = most + self.p["bias"]
        act = np.maximum(pre, 0)
        return np.tanh(act @ self.p["hidden"] + self.p["hidden_bias"]), act, pre, where

    def forward(self, x: np.ndarray, row: np.ndarray, rows: int, places: bool = False) -> tuple:
        hid, act, pre, where = self.hidden(x, places)
        count = np.bincount(row, minlength=rows).astype(np.float32)
        mean = np.stack([np.bincount(row, weights=hid[:, k], minlength=rows) for k in range(HIDDEN)], 1).astype(np.float32) / count[:, None]
        return mean @ self.p["out"] + self.p["out_bias"][0], mean, hid, act, pre, where, count

    def gradient(self, x: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        z, mean, hid, act, pre, where, count = self.forward(x, row, len(y), True)
        prob = 1 / (1 + np.exp(-z))
        loss = float((weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum())
        dz = (weight * (prob - y)).astype(np.float32)
        g = {"out": mean.T @ dz, "out_bias": dz.sum(keepdims=True)}
        dh = (dz / count)[row][:, None] * self.p["out"] * (1 - hid * hid)
        g["hidden"], g["hidden_bias"] = act.T @ dh, dh.sum(0)
        da = (dh @ self.p["hidden"].T) * (pre > 0)
        g["bias"] = da.sum(0)
        # Only the place of the largest response has a gradient.
        span = STRIDE * where[:, :, None] + np.arange(WIDTH)
        byte = x[np.arange(len(x))[:, None, None], span]
        vec = self.p["embed"][byte].reshape(len(x), FILTERS, -1)
        g["filters"] = np.einsum("cfk,cf->kf", vec, da)
        de = (da[:, :, None] * self.p["filters"].T[None]).reshape(-1, EMBED)
        flat = byte.reshape(-1)
        g["embed"] = np.stack([np.bincount(flat, weights=de[:, k], minlength=257) for k in range(EMBED)], 1).astype(np.float32)
        return loss, g

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The score of each row; a few chunks at a time, so that a long text takes little more than its bytes."""
        start, row = chunk_places(offs)
        sums = np.zeros((len(offs) - 1, HIDDEN))
        for i in range(0, len(row), AT_ONCE):
            own = row[i : i + AT_ONCE]
            hid = self.hidden(chunk_bytes(data, start[i : i + AT_ONCE], offs[1:][own]))[0]
            first = own[0] if len(own) else 0
            for k in range(HIDDEN):
                part = np.bincount(own - first, weights=hid[:, k])
                sums[first : first + len(part), k] += part
        mean = sums.astype(np.float32) / np.bincount(row, minlength=len(sums)).astype(np.float32)[:, None]
        return 1 / (1 + np.exp(-(mean @ self.p["out"] + self.p["out_bias"][0]).astype(np.float64)))


def fit(examples: list[tuple[str, int]], epochs: int = 12, least_steps: int = 900, batch: int = 64, seed: int = 7) -> Network | None:
    """Adam on mini-batches, at least least_steps of them; a step takes all chunks of its examples."""
    y = np.array([v for _, v in examples], np.int64)
    if not len(y) or y.min() == y.max():
        return None
    net, r = Network(seed), np.random.default_rng(seed)
    raw = [(t or "").encode() for t, _ in examples]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y).mean())
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    per_epoch = -(-len(raw) // batch)
    epochs = max(epochs, -(-least_steps // per_epoch))
    steps, total = 0, epochs * per_epoch
    for _ in range(epochs):
        order = r.permutation(len(raw))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            texts = [raw[k] for k in own]
            x, row = chunks(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
            _, g = net.gradient(x, row, y[own], weight[own] / len(own))
            steps += 1
            rate = 4e-3 * (1 - steps / (total + 1))
            for k, v in net.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                v -= rate * (m[k] / (1 - 0.9**steps)) / (np.sqrt(s[k] / (1 - 0.999**steps)) + 1e-8)
    return net


def with_scores(docs: DataFrame, model: Network | None, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with the score of each whole text in the column `into`, which replaces one of that name."""
    small_batches(docs.sparkSession)
    kept = [i for i, f in enumerate(docs.schema.fields) if f.name.lower() != into.lower()]
    fields = [docs.schema.fields[i] for i in kept]
    text, names = docs.columns.index(text_col), [*(f.name for f in fields), into]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, offs = text_buffer(b.column(text))
            found = [np.ones(b.num_rows)] if model is None else [model.scores(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in row_groups(offs, 1 << 18)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(np.concatenate(found) if found else np.zeros(0))], names=names)

    return docs.toDF(*map(str, range(len(docs.columns)))).mapInArrow(tidy(run), T.StructType([*fields, T.StructField(into, T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    return fit(sample(docs, labels, "quality", remainder("doc_id", 5) != 0, MOST, MOST_CHARS))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the network does not reject, with all their columns."""
    (score,) = unused(docs, "__score")
    return with_scores(docs, train(docs, labels), into=score).filter(F.col(score) >= ACCEPT).drop(score)
