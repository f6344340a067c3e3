"""Toxicity by multiple-instance learning: documents have labels, sentences have scores.

A sentence's score is a logistic function of its words and word parts; a document is clean when all its
sentences are, so its score is their noisy-or. Training knows only documents' labels: the gradient of the
noisy-or falls on the sentences that explain them. A penalty on weights keeps few features. The model then
locates the offending sentences.

Defined results: null and empty texts count as one sentence without features; a null doc_id is not held
out; without examples of both labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegraph.llm.common import Words, byte_values, row_groups, small_batches, table, text_buffer, tidy, unused
from rolegraph.llm.labelled import remainder, sample

#: Examples of each label, and the longest text among them.
MOST, MOST_CHARS = {1: 1400, 0: 5000}, 20_000
#: Features: whole words, their first 3 to 6 bytes and their last 4 and 5.
AFFIXES = (3, 4, 5, 6, -4, -5)
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
ENDS = np.zeros(256, bool)
ENDS[list(b".!?\n")] = True
VALUES = byte_values()
#: A document is rejected from this score on, a sentence is located from SENTENCE on.
REJECT, SENTENCE = 0.7, 0.5


@dataclass
class Model:
    bias: float
    features: np.ndarray  # sorted hashes
    weights: np.ndarray


class Sentences:
    """The words of some rows with the sentence each lies in; sentences are numbered over all rows."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.words = w = Words(data, offs, SEPARATORS, VALUES, AFFIXES)
        marks = ENDS[data].astype(np.int64)
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(w.rows))
        part = np.cumsum(marks)[w.starts] if len(w.starts) else np.zeros(0, np.int64)
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (self.row[1:] != self.row[:-1])
        self.of_word = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)  # first word of each sentence
        self.row_of = self.row[self.first]
        self.per_row = np.bincount(self.row_of, minlength=len(offs) - 1)

    def features(self) -> Iterator[np.ndarray]:
        """Hashes for each word: the word, then each affix (0 where it has none)."""
        yield self.words.hashes
        yield from self.words.parts.values()


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def candidates(texts: list[bytes], labels: np.ndarray, least: int = 5, ratio: float = 4.0) -> tuple[np.ndarray, list]:
    """Features that at least `least` toxic examples have and whose share there is `ratio` times that in clean ones; and where they are."""
    blocks, ids, counts = [], [], []
    offs = np.cumsum([0, *map(len, texts)])
    for i, j in row_groups(offs):
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        blocks.append((i, j, data, offs[i : j + 1] - offs[i]))
    for wanted in (1, 0):
        for i, j, data, o in blocks:
            s, own = Sentences(data, o), labels[i:j] == wanted
            for f in s.features():
                use = own[s.row] & (f != 0)
                pairs = np.unique(np.stack([f[use], s.row[use].astype(np.uint64)], 1), axis=0)[:, 0] if use.any() else f[:0]
                u, n = np.unique(pairs, return_counts=True)
                if wanted == 0:  # only features that toxic examples have matter
                    at = np.minimum(np.searchsorted(known, u), len(known) - 1)
                    hit = known[at] == u
                    np.add.at(clean, at[hit], n[hit])
                else:
                    ids.append(u)
                    counts.append(n)
        if wanted == 1:
            u, back = np.unique(np.concatenate(ids), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate(counts))
            known, toxic = u[n >= least], n[n >= least]
            clean = np.zeros(len(known))
            if not len(known):
                return known, blocks
    share, other = toxic / max(1, labels.sum()), (clean + 0.5) / max(1, (1 - labels).sum())
    return known[share >= ratio * other], blocks


def fit(examples: list[tuple[str, int]], steps: int = 400, rate: float = 0.1, penalty: float = 2e-4) -> Model | None:
    """Noisy-or training with Adam; None if a label has no example."""
    labels = np.array([y for _, y in examples], np.int64)
    if not len(labels) or labels.min() == labels.max():
        return None
    texts = [(t or "").encode() for t, _ in examples]
    known, blocks = candidates(texts, labels)
    if not len(known):
        return None
    # Sentence by feature, as pairs; sentences without features only count.
    sent, feat, doc_of, plain, base = [], [], [], np.zeros(len(texts)), 0
    for i, j, data, o in blocks:
        s = Sentences(data, o)
        pairs = []
        for f in s.features():
            at = np.minimum(np.searchsorted(known, f), len(known) - 1)
            hit = np.flatnonzero(known[at] == f)
            pairs.append(np.stack([s.of_word[hit], at[hit]], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        with_any, number = np.unique(pairs[:, 0], return_inverse=True)
        sent.append(number + base)
        feat.append(pairs[:, 1])
        doc_of.append(s.row_of[with_any] + i)
        plain[i:j] = np.maximum(s.per_row, 1) - np.bincount(s.row_of[with_any], minlength=j - i)
        base += len(with_any)
    sent, feat, doc_of = np.concatenate(sent), np.concatenate(feat), np.concatenate(doc_of)
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    x = np.r_[np.zeros(len(known)), -7.0]
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        w, b = x[:-1], x[-1]
        z = b + np.bincount(sent, weights=w[feat], minlength=base)
        total = np.bincount(doc_of, weights=softplus(z), minlength=len(texts)) + plain * softplus(b)
        keep = np.exp(-total)
        slope = weight * np.where(labels == 1, -keep / np.maximum(1 - keep, 1e-9), 1.0)
        sig = 1 / (1 + np.exp(-z))
        dz = slope[doc_of] * sig
        g = np.r_[np.bincount(feat, weights=dz[sent], minlength=len(known)) + penalty * np.sign(w), dz.sum() + (slope * plain).sum() / (1 + np.exp(-b))]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        x[:-1] = np.maximum(x[:-1], 0)  # a word never makes a sentence cleaner
    used = x[:-1] > 0.3
    return Model(float(x[-1]), known[used], x[:-1][used])


def with_scores(docs: DataFrame, model: Model | None, text_col: str = "text", into: str = "score", located: str | None = None) -> DataFrame:
    """docs with the score of each text; located: a column for the offending sentences (code points, score).

    The new columns replace those of their names.
    """
    small_batches(docs.sparkSession)
    kept = [i for i, f in enumerate(docs.schema.fields) if f.name.lower() not in {into.lower(), (located or into).lower()}]
    text, fields = docs.columns.index(text_col), [*(docs.schema.fields[i] for i in kept), T.StructField(into, T.DoubleType())]
    spans = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    if located:
        fields.append(T.StructField(located, spans))
    struct = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    seen = np.zeros(1 << 16, bool)
    if model is not None:
        seen[(model.features & np.uint64(0xFFFF)).astype(np.int64)] = True

    def of_rows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list]:
        n = len(offs) - 1
        if model is None or not len(model.features):
            return np.zeros(n), [[] for _ in range(n)]
        s = Sentences(data, offs)
        z = np.full(len(s.first), model.bias)
        for f in s.features():
            maybe = np.flatnonzero(seen[(f & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(model.features, f[maybe]), len(model.features) - 1)
            hit = model.features[at] == f[maybe]
            # A feature counts once in a sentence, as in training.
            pairs = np.unique(np.stack([s.of_word[maybe[hit]], at[hit]], 1), axis=0)
            np.add.at(z, pairs[:, 0], model.weights[pairs[:, 1]])
        total = np.bincount(s.row_of, weights=softplus(z), minlength=n) + (s.per_row == 0) * softplus(np.array(model.bias))
        found: list[list] = [[] for _ in range(n)]
        if located:
            p = 1 / (1 + np.exp(-z))
            ends = np.r_[s.first[1:], len(s.words.starts)] - 1
            for k in np.flatnonzero(p >= SENTENCE):
                row = s.row_of[k]
                begin, end = s.words.starts[s.first[k]], s.words.ends[ends[k]]
                head = len(data[offs[row] : begin].tobytes().decode())
                found[row].append({"begin": head, "end": head + len(data[begin:end].tobytes().decode()), "score": float(p[k])})
        return -np.expm1(-total), found

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, offs = text_buffer(b.column(text))
            parts = [of_rows(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in row_groups(offs)]
            scores = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0)
            extra = [pa.array([x for _, f in parts for x in f], struct)] if located else []
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(scores), *extra], names=[f.name for f in fields])

    return docs.toDF(*map(str, range(len(docs.columns)))).mapInArrow(tidy(run), T.StructType(fields))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from labelled rows whose crc32(doc_id) mod 3 is not 1."""
    return fit(sample(docs, labels, "toxic", remainder("doc_id", 3) != 1, MOST, MOST_CHARS))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns."""
    (score,) = unused(docs, "__score")
    return with_scores(docs, train(docs, labels), into=score).filter(F.col(score) < REJECT).drop(score)
