"""Ranked lexical search of a set of queries over all documents, exact, with whole texts.

The index is split by documents: each of its rows is a block of documents with the posting lists of all their terms,
so a frequent term is spread over all blocks and postings are never shuffled. Statistics are sums over the blocks.
A block is searched for each query in the hybrid way: the query's short lists are summed term at a time into
accumulators; those are from then on one more list, in document order and with a bound like the others. The lists that
alone cannot lift a document over the query's threshold are only looked up; the rest is traversed document at a time,
a range of documents per step, with candidates skipping through the looked-up lists while their bound lasts. The
threshold is the score of the query's k-th best document so far and passes on from block to block of a task.

Queries are read in blocks of at most about QUERY_CHARS characters and QUERY_ROWS rows, each with a pass over the
index; what such a block's terms need is all that the driver holds and what is sent to tasks.

Terms are 64-bit hashes. Defined results: null and empty texts have no terms; documents without a term count nowhere;
a query without a term that a document has gives no rows; rows of queries with equal ids are queries of their own; rows
of documents with equal ids are documents of their own; null ids rank after others of equal score; other columns are
not read; empty tables give no rows. 25 * terms of a document * number of documents must stay below 2^63.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolegraph.llm.common import Scratch, Words, byte_values, row_groups, small_batches, table, text_buffer, tidy

#: What is no part of a term, after A-Z became a-z.
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
VALUES = byte_values()
#: Terms after which a block of documents is closed, and the bytes of a text that are split into terms at once.
BLOCK_TERMS, SLICE = 1 << 20, 1 << 21
#: Documents of one step of the traversal.
RANGE = 4096
#: Postings of short lists that are summed into accumulators: a share of the block's documents, and at least so many.
SHORT_SHARE, SHORT_LEAST = 8, 512
QUERY_ROWS, QUERY_CHARS = 4096, 4 << 20
#: A vectored read holds a row group's whole text column a second time, outside the heap.
READ = {"parquet.hadoop.vectored.io.enabled": "false"}
INDEX = "docs int, terms_all long, doc_ids array<long>, lengths array<long>, terms array<long>, ends array<int>, at array<int>, tf array<int>"


def term_hashes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), SEPARATORS, VALUES).hashes


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in slices that cut no term."""
    at = 0
    while at < len(data):
        end = at + SLICE
        while end < len(data):
            gap = np.flatnonzero(SEPARATORS[data[end : end + SLICE]])
            if len(gap):
                end += int(gap[0])
                break
            end += SLICE
        yield data[at:end]
        at = end


def counted(row: np.ndarray, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that agree in row and term as one, sorted by term and then row; rows come in ascending order."""
    order = np.argsort(term, kind="stable")
    row, term, n = row[order], term[order], n[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    return row[first], term[first], np.add.reduceat(n, first) if len(first) else n


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs, a row for each block of documents; write it before use."""
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in INDEX.split(", ")]
    types = [pa.int32(), pa.int64(), *map(pa.list_, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))]

    def closed(ids: list, lengths: list, parts: list) -> pa.RecordBatch:
        row, term, tf = counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        last = np.flatnonzero(np.r_[term[1:] != term[:-1], True])
        values = [len(ids), sum(lengths), ids, lengths, term[last].view(np.int64), last + 1, row, tf]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, parts, held = [], [], [], 0
        for b in it:
            doc_ids = b.column(0).to_pylist()
            data, offs = text_buffer(b.column(1))
            for i, j in row_groups(offs):
                own, lens = data[offs[i] : offs[j]], np.zeros(j - i, np.int64)
                found = []
                for part in pieces(own) if j == i + 1 else [own]:
                    bounds = offs[i : j + 1] - offs[i] if j > i + 1 else np.array([0, len(part)])
                    w = Words(part, bounds, SEPARATORS, VALUES)
                    n = np.diff(w.rows)
                    lens += n
                    found.append(counted(np.repeat(np.arange(len(n)), n), w.hashes, np.ones(len(w.hashes), np.int64)))
                have = np.flatnonzero(lens)
                place = np.cumsum(lens > 0) - 1 + len(ids)  # documents without terms get no place
                for row, term, n in found:
                    order = np.argsort(row, kind="stable")
                    parts.append((place[row[order]], term[order], n[order]))
                ids += [doc_ids[i + r] for r in have.tolist()]
                lengths += lens[have].tolist()
                held += int(lens.sum())
                if held >= BLOCK_TERMS:
                    yield closed(ids, lengths, parts)
                    ids, lengths, parts, held = [], [], [], 0
        if held:
            yield closed(ids, lengths, parts)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(tidy(run), INDEX)


def array_of(b: pa.RecordBatch, name: str, r: int) -> np.ndarray:
    return b.column(name)[r].values.to_numpy(zero_copy_only=False)


def document_counts(index: DataFrame, sought: np.ndarray) -> np.ndarray:
    """How many documents hold each sought term (sorted hashes): a sum over all blocks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sought), np.int64)
        for b in it:
            for r in range(b.num_rows):
                terms, ends = array_of(b, "terms", r).view(np.uint64), array_of(b, "ends", r)
                at, has = looked_up(terms, sought)
                total[has] += np.diff(ends, prepend=0)[at[has]]
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["term", "n"])

    out = np.zeros(len(sought), np.int64)
    for row in index.select("terms", "ends").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return out


def looked_up(terms: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each sought term is among sorted terms, and whether it is there."""
    at = np.minimum(np.searchsorted(terms, sought), len(terms) - 1)
    return at, terms[at] == sought


class Lists:
    """What a block holds of the sought terms: their documents, in order, and what each term adds to their scores."""

    def __init__(self, b: pa.RecordBatch, r: int, sought: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        ids = b.column("doc_ids")[r].values
        self.no_id = np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy()
        m = 75 + (25 * array_of(b, "lengths", r) * n_docs) // n_terms
        ends = array_of(b, "ends", r).astype(np.int64)
        at, has = looked_up(array_of(b, "terms", r).view(np.uint64), sought)
        has &= weight > 0
        start, size = np.where(at > 0, ends[at - 1], 0), np.zeros(len(sought), np.int64)
        size[has] = (ends[at] - start)[has]
        #: The list of sought term t lies from first[t] to first[t + 1].
        self.first = np.concatenate([[0], np.cumsum(size)])
        own = np.repeat(start - self.first[:-1], size) + np.arange(self.first[-1])
        self.docs = array_of(b, "at", r)[own].astype(np.int64)
        tf = array_of(b, "tf", r)[own].astype(np.int64)
        self.adds = np.repeat(weight, size) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.docs]))
        self.most = np.zeros(len(sought), np.int64)
        if len(full := np.flatnonzero(size)):
            self.most[full] = np.maximum.reduceat(self.adds, self.first[full])


class Best:
    """The k best documents of one query so far, by score, then id."""

    def __init__(self, k: int):
        self.k, self.threshold = k, 1  # only scores above 0 count
        self.scores, self.ids, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        s, i, n = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.no_id, no_id])
        top = np.lexsort((i, n, -s))[: self.k]
        self.scores, self.ids, self.no_id = s[top], i[top], n[top]
        if len(top) == self.k:
            self.threshold = max(self.threshold, int(self.scores[-1]))


def search_block(lists: Lists, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
    """Adds a block's documents to the best of a query. terms: which of the sought terms it has; times: how often each."""
    size = lists.first[terms + 1] - lists.first[terms]
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return
    n_docs = len(lists.ids)
    short = int(np.searchsorted(np.cumsum(size[order]), max(SHORT_LEAST, n_docs // SHORT_SHARE), "right"))

    def listed(o: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(lists.first[terms[o]], lists.first[terms[o] + 1])
        return lists.docs[own], lists.adds[own] * times[o] if times[o] > 1 else lists.adds[own]

    # Term at a time: short lists become summed accumulators, one list from here on.
    sources = []
    if short:
        docs, adds = (np.concatenate(x) for x in zip(*map(listed, order[:short].tolist()), strict=True))
        by_doc = np.argsort(docs, kind="stable")
        docs, adds = docs[by_doc], adds[by_doc]
        first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        docs, adds = docs[first], np.add.reduceat(adds, first)
        sources.append((int(adds.max()), docs, adds))
    threshold = best.threshold
    if short and len(docs) >= best.k:  # sums are lower bounds of scores already
        threshold = max(threshold, int(np.partition(adds, len(adds) - best.k)[len(adds) - best.k]))
    sources += [(int(lists.most[terms[o]] * times[o]), *listed(o)) for o in order[short:].tolist()]
    # Document at a time over all lists, in ranges; those of low bounds come first.
    sources.sort(key=lambda s: s[0])
    bounds = np.cumsum([s[0] for s in sources])
    for low in range(0, n_docs, RANGE):
        threshold = max(threshold, best.threshold)
        looked = int(np.searchsorted(bounds, threshold))  # these together stay below the threshold: never a reason to score a document
        if looked == len(sources):
            return
        sums, high = np.zeros(min(RANGE, n_docs - low), np.int64), low + RANGE
        for _, docs, adds in sources[looked:]:
            a, z = np.searchsorted(docs, (low, high)) if n_docs > RANGE else (0, len(docs))
            sums[docs[a:z] - low] += adds[a:z]
        found = np.flatnonzero(sums)
        scores = sums[found]
        for s in range(looked - 1, -1, -1):
            stays = scores + bounds[s] >= threshold
            if not stays.all():
                found, scores = found[stays], scores[stays]
            if not len(found):
                break
            _, docs, adds = sources[s]
            at = np.searchsorted(docs, found + low)
            hit = np.flatnonzero(docs[np.minimum(at, len(docs) - 1)] == found + low)
            scores[hit] += adds[at[hit]]
        own = scores >= threshold
        if own.any():
            docs = found[own] + low
            best.add(scores[own], lists.ids[docs], lists.no_id[docs])


def of_each(df: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top(index: DataFrame, queries: list[tuple[int, np.ndarray]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query, rank, doc_id, score: the k best documents of each query (number, hashes of its terms)."""
    sought = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in queries)]))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in document_counts(index, sought).tolist()], np.int64)
    asked = [(q, *np.unique(np.searchsorted(sought, h), return_counts=True)) for q, h in queries]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for b in it:
            for r in range(b.num_rows):
                lists = Lists(b, r, sought, weight, n_docs, n_terms)
                for (_, terms, times), own in zip(asked, best, strict=True):
                    search_block(lists, terms, times, own)
        part = TaskContext.get().partitionId()
        for (q, _, _), own in zip(asked, best, strict=True):
            if n := len(own.scores):
                yield pa.RecordBatch.from_arrays([pa.array([q] * n), pa.array([part % 64] * n, pa.int32()), pa.array(own.ids, mask=own.no_id), pa.array(own.scores)], names=["query", "part", "doc_id", "score"])

    found = index.mapInArrow(tidy(run), "query long, part int, doc_id long, score long")
    # Two steps, so that a query's best rows of many tasks don't meet in one at once.
    return of_each(of_each(found, ["query", "part"], k).drop("rank"), ["query"], k).select("query", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", query_col: str = "text", query_rows: int = QUERY_ROWS, query_chars: int = QUERY_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each row of items."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    index = scratch.keep(build(docs), group_rows=1)
    # A query's number tells its partition and place; it is fixed when the table is written.
    asked = scratch.keep(items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{query_col}`").cast("string").alias("text")).withColumn("query", F.monotonically_increasing_id()))
    n_docs, n_terms = index.agg(F.sum("docs"), F.sum("terms_all")).first()
    rows, chars = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not n_docs or not rows:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks, out = max(math.ceil(rows / query_rows), math.ceil(chars / query_chars)), None
    for n in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n)
        texts = own.select("query", "text").collect()  # about QUERY_CHARS characters
        found = top(index, [(r.query, term_hashes(r.text)) for r in texts], n_docs, n_terms, k)
        found = scratch.keep(found) if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents", **READ), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents
), g AS (
  SELECT count(*)::BIGINT AS N, sum(len(terms))::BIGINT AS L FROM d WHERE len(terms) > 0
), m AS (
  SELECT r, doc_id, (75 + (25 * len(terms)::BIGINT * N) // L)::BIGINT AS m FROM d, g WHERE len(terms) > 0
), q AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
), p AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(N) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term
), s AS (
  SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL
), k AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""
