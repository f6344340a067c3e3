"""Near-duplicates by a chosen-path set similarity join on MinHash tokens.

A document is the set of its word shingles; SIZE minwise tokens stand for the set. Each of several trees
starts with all documents in one node. A node selects one of the tokens' positions, or two, by a hash of
its path; its children hold the documents that have equal tokens there, so similar documents stay together
far more often than others. Nodes of at most LEAF documents are compared exhaustively by their tokens. Nodes
that are still larger at the last level are compared with a few of their members, in blocks.

Links are confirmed on the full sets of shingles. The first pass confirms for each document only its most
similar candidate. The second takes the documents of a node that have a candidate in another component,
counts the common shingles of all of them at once as a matrix product of the sets, and joins components that
have a link. In large nodes the documents outside the node's main component are taken
against all its members, in tiles. So no pair of a node stays untried, and pairs are never stored.

Defined results: documents with equal sets are one node of the graph; null and empty texts have no shingles
and are linked with nothing; a text of fewer words than a shingle is one shingle; null doc_ids come after
all others; rows with equal doc_id and text share a component. Extra columns are not read. `kept` compares
doc_ids, so it holds for several rows where ids are null or repeated; one_of_each() decides by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.llm.common import ASCII_SPACE, Scratch, Words, byte_values, fitted, key_runs, mix64, row_groups, small_batches, table, text_buffer, tidy, unused
from rolegraph.llm.components import components, stars
from rolegraph.llm.decisions import BUCKETS, bucket, decided_rows

SIZE, TREES, DEPTH, LEAF = 64, 8, 4, 128
#: Members of a large node that all others are compared with, and the size of its blocks.
PIVOTS, BLOCK = 8, 512
#: Shingles of a large node's members that one task takes at once in the second pass.
TILE = 1 << 20
#: Equal tokens of SIZE from which a pair is confirmed; a pair of similarity 0.8 has fewer with a chance of about 1e-4.
LEAST = 39
VALUES = byte_values()
_R = np.random.default_rng(20)
FACTORS = _R.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NO_ID = -(1 << 63)
#: About the bytes of a row that holds tokens, and of one of a few numbers, where the rows of a stage are counted.
TOKEN_ROW, ROW = 300, 32


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted hashes of its distinct shingles of `size` words."""
    w = Words(data, offs, ASCII_SPACE, VALUES)
    h, k = w.hashes, np.uint64(0x9E3779B97F4A7C15)
    n = len(h) - size + 1
    acc = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        acc = acc * k + (h[i : n + i] if n > 0 else h[:0])
    acc = mix64(acc)
    for a, z in zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True):
        if z - a >= size:
            yield np.unique(acc[a : z - size + 1])
        elif z > a:
            one = np.array([z - a], np.uint64)
            for x in h[a:z]:
                one = one * k + x
            yield mix64(one)
        else:
            yield h[:0]


def minwise(s: np.ndarray) -> np.ndarray:
    """SIZE tokens of a set: the smallest product with each factor, its high half."""
    least = np.full(SIZE, np.uint64((1 << 64) - 1))
    for i in range(0, len(s), 4096):
        np.minimum(least, (FACTORS[:, None] * s[None, i : i + 4096]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def text_sha(c: str):
    return F.unhex(F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"), 256))


def set_features(docs: DataFrame, size: int, sha: bool = False) -> DataFrame:
    """doc_id, n_shingles, c (a hash of the set), tokens, and with sha a hash of the text."""
    small_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, offs = text_buffer(b.column(1))
            n, c, tokens = [], [], []
            for i, j in row_groups(offs):
                for s in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size):
                    n.append(len(s))
                    c.append(set_hash(s))
                    tokens.append(minwise(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(tokens, pa.binary()), *b.columns[2:]], names=["doc_id", "n_shingles", "c", "tokens", *b.schema.names[2:]])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([text_sha("text").alias("sha")] if sha else []))
    return rows.mapInArrow(tidy(run), "doc_id long, n_shingles long, c long, tokens binary" + (", sha binary" if sha else ""))


def set_hash(s: np.ndarray) -> int:
    return int(mix64(mix64(s + np.uint64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.uint32).reshape(len(column), SIZE)


def children(node: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and child node, for the one or two positions that each row's node selects."""
    h = mix64(node + np.uint64(0x51ED270B))
    first, second = (h & np.uint64(63)).astype(np.int64), ((h >> np.uint64(8)) & np.uint64(63)).astype(np.int64)
    two = ((h >> np.uint64(32)) & np.uint64(3) == 0) & (first != second)
    rows = np.arange(len(node))
    out = []
    for r, position in ((rows, first), (rows[two], second[two])):
        token = tokens[r, position].astype(np.uint64)
        out.append((r, mix64(mix64(node[r] * np.uint64(31) + position.astype(np.uint64)) + token)))
    return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])


def _branch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c, tokens and perhaps node (else the roots of all trees) to node and c of the next level."""
    for b in it:
        if b.num_rows:
            t, c = matrix(b.column("tokens")), np.asarray(b.column("c"))
            roots = [np.full(len(c), mix64(np.array([k + 1], np.uint64))[0]) for k in range(TREES)] if "node" not in b.schema.names else [np.asarray(b.column("node")).view(np.uint64)]
            for node in roots:
                r, child = children(node, t)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(c[r])], names=["node", "c"])


def counted(below: DataFrame, scratch: Scratch, n_rows: int) -> DataFrame:
    """node, c, n of nodes with more than one document. below: a kept table of n_rows rows node, c.

    The sizes are a table of their own, so a node with many documents is split by a skewed join.
    """
    sizes = scratch.keep(below.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), n_rows * ROW)
    return scratch.keep(below.join(sizes, "node"), n_rows * ROW)


def compare(rows: DataFrame, classes: DataFrame, best: bool, n_rows: int) -> DataFrame:
    """Pairs within nodes with at least LEAST equal tokens, one of them a pivot, in different components.

    rows: node, c, pivot, comp; n_rows of them. best: a, b, equal: for each b in a node its most similar a.
    Otherwise: the rows that are in any such pair; nodes where the same rows are left get the same new name, so
    that they need not be tried twice.
    """
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("equal", pa.int64())] if best else [("node", pa.int64()), ("c", pa.int64()), ("comp", pa.int64()), ("pivot", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(it, "node"):
            node, c, comp, pivot = (np.asarray(t.column(k)) for k in ("node", "c", "comp", "pivot"))
            tokens = matrix(t.column("tokens"))
            begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            each = np.diff(np.r_[begin, len(node)])
            start = np.repeat(begin, each)
            place = np.arange(len(node)) - start
            pivots = np.repeat(np.add.reduceat(pivot, begin), each)
            top, of, met = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.zeros(len(node), bool)
            for k in range(int(pivots.max())):
                r = np.flatnonzero((place > k) & (pivots > k))
                p = start[r] + k
                differ = comp[r] != comp[p]
                r, p = r[differ], p[differ]
                for i in range(0, len(r), 2048):
                    x, y = r[i : i + 2048], p[i : i + 2048]
                    equal = (tokens[x] == tokens[y]).sum(1)
                    if best:
                        better = equal > top[x]
                        top[x[better]], of[x[better]] = equal[better], c[y[better]]
                    else:
                        hit = equal >= LEAST
                        met[x[hit]] = met[y[hit]] = True
            keep = top >= LEAST if best else met
            if keep.any():
                if not best:
                    own = np.where(met, mix64(c.view(np.uint64) * np.uint64(2) + pivot.astype(np.uint64)), np.uint64(0))
                    node = np.repeat(mix64(np.add.reduceat(own, begin)), each).view(np.int64)
                columns = (of, c, top) if best else (node, c, comp, pivot)
                yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in columns], schema=out)

    full = rows.join(classes.select("c", "tokens"), "c").select("node", "c", "comp", F.col("pivot").cast("long").alias("pivot"), "tokens")
    dealt = fitted(full.repartition("node"), n_rows * TOKEN_ROW).sortWithinPartitions("node", F.desc("pivot"), "c")
    found = dealt.mapInArrow(tidy(run), ", ".join(f"{n} long" for n in out.names))
    return found if best else found.distinct()


def texts_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, size: int, sets: bool) -> DataFrame:
    """c and the text (or the packed set) of one document of each class of ids (c).

    Documents whose id falls in no bucket of the wanted ids leave before the join.
    """
    some_id = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID))
    wanted = ids.join(classes, "c").select(some_id("min_doc").alias("doc")).distinct()
    buckets = F.broadcast(wanted.select(bucket("doc").alias("bucket")).distinct())  # at most BUCKETS rows
    found = docs.select(some_id("doc_id").alias("doc"), F.col("text").cast("string").alias("text")).withColumn("bucket", bucket("doc")).join(buckets, "bucket", "left_semi")
    found = found.join(wanted.hint("shuffle_hash"), "doc", "left_semi").select("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, offs = text_buffer(b.column(0))
            c, packed = [], []
            for i, j in row_groups(offs):
                for s in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size):
                    c.append(set_hash(s))
                    packed.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(packed, pa.binary()) if sets else b.column(0)], names=["c", "body"])

    return found.mapInArrow(tidy(run), "c long, body binary" if sets else "c long, body string").dropDuplicates(["c"])


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    texts = scratch.keep(texts_of(ids, classes, docs, size, sets=False))

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok = []
            (da, oa), (db, ob) = text_buffer(b.column("text_a")), text_buffer(b.column("text_b"))
            for i, j in row_groups(oa + ob):
                for x, y in zip(shingle_sets(da[oa[i] : oa[j]], oa[i : j + 1] - oa[i], size), shingle_sets(db[ob[i] : ob[j]], ob[i : j + 1] - ob[i], size), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok)], names=["a", "b", "ok"])

    text = lambda p: texts.select(F.col("c").alias(p), F.col("body").alias(f"text_{p}"))
    return pairs.select("a", "b").join(text("a"), "a").join(text("b"), "b").mapInArrow(tidy(check), "a long, b long, ok boolean").filter("ok").select("a", "b")


def common_counts(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Sizes of the intersections of the first sets with all sets, as a matrix product over the shingles that two of them have."""
    ids, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.full(len(ids), -1)
    column[n > 1] = np.arange((n > 1).sum())
    row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), column[at]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out, width = np.zeros((first, len(sets)), np.float32), 1024
    for lo in range(0, int((n > 1).sum()), width):
        a, z = np.searchsorted(at, [lo, lo + width])
        held = np.zeros((len(sets), width), np.float32)
        held[row[a:z], at[a:z] - lo] = 1
        out += held[:first] @ held.T
    return out


def exact_links(rows: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: components that a link of any pivot joins, as stars of each node. rows: node, c, comp, pivot."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(it, "node"):
            node, c, comp, pivot = (np.asarray(t.column(k)) for k in ("node", "c", "comp", "pivot"))
            packed = t.column("body").to_pylist()
            edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
            links = []
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                n = int(pivot[a:z].sum())
                if n == 0 or z - a < 2:
                    continue
                sets = [np.frombuffer(b, np.uint64) for b in packed[a:z]]
                length = np.array([len(s) for s in sets], np.float64)
                common = common_counts(sets, n).astype(np.float64)
                near = 100 * common >= percent * (length[:n, None] + length[None, :] - common)
                x, y = np.nonzero(near & (comp[a : a + n, None] != comp[None, a:z]))
                if len(x):
                    links.append(stars(comp[a + x], comp[a + y]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in np.concatenate(links, 1)], names=["a", "b"])

    sets = texts_of(rows.select("c").distinct(), classes, docs, size, sets=True)
    return rows.join(sets, "c").repartition("node").sortWithinPartitions("node", F.desc("pivot"), "c").mapInArrow(tidy(run), "a long, b long")


def candidate_nodes(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """node, c, n of the leaves and of the nodes that are large at the last level."""
    rows, leaves = None, None
    for _ in range(DEPTH):
        large = None if rows is None else rows.filter(F.col("n") > LEAF)
        if large is not None and large.isEmpty():
            break
        above = classes.select("c", "tokens") if large is None else large.select("node", "c").join(classes.select("c", "tokens"), "c")
        below = scratch.keep(above.mapInArrow(tidy(_branch), "node long, c long"))
        rows = counted(below, scratch, below.count())
        scratch.drop(below)
        some = rows.filter(F.col("n") <= LEAF)
        leaves = some if leaves is None else leaves.unionByName(some)
    return leaves, rows.filter(F.col("n") > LEAF)


def _spread(node: str, number):
    return F.xxhash64(F.col(node), number)


def grouped(docs: DataFrame, size: int, percent: int, scratch: Scratch, sha: bool = False) -> tuple[DataFrame, DataFrame]:
    """The features of docs, and c, component, min_doc of each set of shingles."""
    features = scratch.keep(set_features(docs, size, sha))
    per_set = features.filter("n_shingles > 0").groupBy("c").agg(F.min("doc_id").alias("min_doc"), F.first("tokens").alias("tokens"), F.first("n_shingles").alias("n_shingles"))
    classes = scratch.keep(per_set, features.count() * TOKEN_ROW)
    leaves, large = candidate_nodes(classes, scratch)

    # First pass: each document's most similar candidate.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    is_pivot = F.pmod(F.xxhash64("node", "c"), F.col("n")) < PIVOTS
    own = F.pmod(F.hash("c"), blocks)
    rows = leaves.select("node", "c", F.lit(True).alias("pivot"))
    rows = rows.unionByName(large.filter(is_pivot).select("node", "c", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("k"), F.lit(True).alias("pivot")).select(_spread("node", F.col("k")).alias("node"), "c", "pivot"))
    rows = scratch.keep(rows.unionByName(large.filter(~is_pivot).select(_spread("node", own).alias("node"), "c", F.lit(False).alias("pivot"))))
    n_rows = rows.count()
    first = compare(rows.withColumn("comp", F.col("c")), classes, True, n_rows)
    first = scratch.keep(first.groupBy("b").agg(F.max(F.struct("equal", "a")).alias("m")).select("m.a", "b"), n_rows * ROW)
    links = scratch.keep(confirmed(first, classes, docs, size, percent, scratch))
    comp = components(links, scratch)
    scratch.drop(rows)

    # Second pass: all pairs of a node that lie in different components.
    labelled = lambda x: x.join(comp.withColumnRenamed("id", "c"), "c", "left").withColumn("comp", F.coalesce("component", "c")).drop("component")
    small, big = scratch.keep(labelled(leaves), n_rows * ROW), scratch.keep(labelled(large), n_rows * ROW)
    mixed = small.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("node")
    rows = small.join(mixed, "node", "left_semi").select("node", "c", "comp", F.lit(True).alias("pivot"))
    sized = big.join(classes.select("c", "n_shingles"), "c")
    main = sized.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("w")).groupBy("node").agg(F.max(F.struct("k", "comp", "w")).alias("m"), F.sum("w").alias("w"))
    main = main.select("node", F.col("m.comp").alias("main"), F.ceil(F.col("w") / TILE).cast("int").alias("blocks"), F.ceil(2 * (F.col("w") - F.col("m.w")) / TILE).cast("int").alias("groups")).filter("groups > 0")
    big_rows = big.join(scratch.keep(main, n_rows * ROW), "node").withColumn("pivot", F.col("comp") != F.col("main"))
    tile = lambda k, g: F.xxhash64("node", k, g).alias("node")
    group, block = F.pmod(F.hash("c"), F.col("groups")), F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    seekers = big_rows.filter("pivot").withColumn("g", group).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sought = big_rows.withColumn("k", block).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).filter(~F.col("pivot") | (F.col("g") != group))
    rows = scratch.keep(rows.unionByName(seekers.select(tile("k", "g"), "c", "comp", "pivot")).unionByName(sought.select(tile("k", "g"), "c", "comp", F.lit(False).alias("pivot"))))
    n_rows = rows.count()
    suspects = scratch.keep(compare(rows, classes, False, n_rows), n_rows * ROW)
    if not suspects.isEmpty():
        comp = components(links.unionByName(exact_links(suspects, classes, docs, size, percent)), scratch)
    scratch.drop(rows, small, big)
    return features, classes.select("c", "min_doc").join(comp.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    features, named = grouped(docs, size, percent, scratch)
    named = scratch.keep(named)
    least = scratch.keep(named.groupBy("component").agg(F.min("min_doc").alias("component_id")))
    named = named.join(least, "component").select("c", "component_id")
    some = features.filter("n_shingles > 0").select("doc_id", "n_shingles", "c").join(named, "c")
    none = features.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    out = some.select("doc_id", "n_shingles", "component_id").unionByName(none.select("doc_id", "n_shingles", "component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each group, and all rows without shingles.

    Of a group the row of the smallest doc_id stays (null after all others), of equal doc_ids that of the
    smallest hash of the text, and one row where both are equal.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    features, named = grouped(docs, size, percent, scratch, sha=True)
    rows = features.filter("n_shingles > 0").select("doc_id", "sha", "c").join(named.select("c", "component"), "c")
    keys = scratch.keep(rows.groupBy("component", "doc_id", "sha").agg(F.count(F.lit(1)).alias("n")))
    first = keys.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("m")).select("m.doc_id", "m.sha", F.lit(True).alias("first"))
    at = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.sha") == F.col(f"{y}.sha"))
    # The rows of first that occur once need no decision.
    decided = keys.alias("k").join(first.alias("f"), at("k", "f"), "left").filter("first is null or n > 1").select(F.col("k.doc_id").alias("doc"), F.col("k.sha").alias("sha"), F.coalesce("first", F.lit(False)).alias("first"))
    return decided_rows(docs, scratch.keep(decided), F.col("doc_id").cast("long"), text_sha("text"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
r AS (SELECT doc_id AS id, doc_id AS reach FROM s UNION SELECT r.id, link.b FROM r JOIN link ON link.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.id = s.doc_id
"""
