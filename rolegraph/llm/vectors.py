"""Near-duplicate vectors by spherical-cap filters.

Filters are directions on the sphere with a structured code: one of TURNS fixed rotations, then two halves,
each with as many random code words; every pair of code words is a direction. A vector is decoded to the list
of all directions whose cap it lies in. Since a product is a sum of two parts, only code words whose part can
still reach the bound are tried. Caps and code follow the number of distinct vectors: a cap holds about
OCCUPANCY of them, and the code has so many words that two vectors at the bound share GOAL filters on average.
So a vector's filters and its partners in each hardly grow with the table.

Vectors meet in their filters as sketches of a byte per component with a proven bound of the error; those that
have a possible partner there meet once more as they are, and are verified in double precision. A pair is counted
in the first filter that both have, so no pair is counted twice and pairs themselves are never stored; a filter
with many vectors is dealt out as tiles.

Defined results: null, zero, and empty vectors and those with null or non-finite components link with
nothing; vectors of different lengths don't link; equal vectors are one node with a weight and link with
each other; lengths may be as large or small as doubles are; null vec_ids come after all others. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.llm.common import Scratch, key_runs, small_batches, table, tidy
from rolegraph.llm.components import components

TURNS, OCCUPANCY, GOAL = 12, 24, 8.0
#: A cap is at least so wide that a vector at the bound from one in it lies in it with this chance.
STAYS = 0.12
#: Vectors of a filter that one task compares with each other, or with as many others.
TILE = 1024


@lru_cache(64)
def code(dim: int, turn: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and the code words of both halves."""
    r = np.random.default_rng([dim, turn])
    rotation = np.linalg.qr(r.normal(size=(dim, dim)))[0]
    halves = [r.normal(size=(words, n)) for n in (dim // 2, dim - dim // 2)]
    return (rotation, *(h / np.linalg.norm(h, axis=1, keepdims=True) for h in halves))


def tail(dim: int, grid: np.ndarray) -> np.ndarray:
    """The share of the sphere whose product with a direction is at least each value of an even grid from -1 to 1."""
    density = np.exp(0.5 * (dim - 3) * np.log(np.maximum(1 - grid * grid, 1e-300))) if dim > 3 else np.ones(len(grid))
    mass = np.r_[0, np.cumsum((density[1:] + density[:-1])[::-1])][::-1]
    return mass / mass[0]


@lru_cache(64)
def plan(dim: int, n: int, least: float) -> tuple[int, float]:
    """Code words of a half, and the least product of a vector with a direction whose cap it lies in.

    dim is at least 4; numbers are rounded up to powers of two, so tables of about one size share a plan.
    """
    n = 1 << max(4, int(np.ceil(np.log2(max(n, 1)))))
    grid = np.linspace(-1, 1, 20_001)
    share, other = tail(dim, grid), tail(dim - 1, grid)
    density = np.maximum(-np.diff(share), 0)
    middle, rest = (grid[1:] + grid[:-1]) / 2, np.sqrt(max(1e-12, 1 - least * least))
    best = None
    for at in np.unique(np.searchsorted(-share, -np.geomspace(0.2, 1e-12, 160))):
        bound = grid[min(at, len(grid) - 2)]
        inside = middle >= bound
        # The other vector's product is least * t + rest * sqrt(1 - t^2) * s with s as in one dimension less.
        s = (bound - least * middle[inside]) / (rest * np.sqrt(np.maximum(1 - middle[inside] ** 2, 1e-12)))
        both = float((density[inside] * np.interp(s, grid, other, left=1, right=0)).sum())
        p = float(density[inside].sum())
        if best is not None and (p * n < OCCUPANCY or both < STAYS * p):
            break
        best = (int(np.ceil(np.sqrt(GOAL / both / TURNS))), float(bound))
    return max(4, best[0]), best[1]


def decode(unit: np.ndarray, words: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and filter of every cap that a row of unit vectors lies in, sorted."""
    dim, step = unit.shape[1], max(1, (1 << 20) // words)
    rows, filters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(unit), step):
        for turn in range(TURNS):
            rotation, first, second = code(dim, turn, words)
            y = unit[i : i + step] @ rotation
            a, b = y[:, : dim // 2] @ first.T, y[:, dim // 2 :] @ second.T
            least = bound * np.sqrt(2)
            row, word = np.nonzero(a >= (least - b.max(1))[:, None])
            for k in range(0, len(row), step):
                r, w = row[k : k + step], word[k : k + step]
                at, other = np.nonzero(b[r] >= (least - a[r, w])[:, None])
                rows.append(r[at] + i)
                filters.append((turn * words + w[at]) * words + other)
    row, f = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort((f, row))
    return row[order], f[order]


def unit(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def padded(u: np.ndarray) -> np.ndarray:
    return np.pad(u, ((0, 0), (0, max(0, 4 - u.shape[1]))))


def sketches(u: np.ndarray) -> np.ndarray:
    """A row of bytes for each unit vector: step and error as 32-bit floats, then a byte for each component."""
    step = np.abs(u).max(1) / 127
    q = np.rint(u / step[:, None])
    error = np.linalg.norm(u - q * step.astype(np.float32).astype(np.float64)[:, None], axis=1) + 1e-6
    head = np.stack([step.astype(np.float32), np.nextafter(error.astype(np.float32), np.float32(1))], 1)
    return np.concatenate([head.view(np.uint8).reshape(len(u), 8), q.astype(np.int8).view(np.uint8)], 1)


def valid_classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with the hash c of their vector (null if it links with nothing), and a row for each c."""
    v = F.col(vector_col)
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(~bad, F.transform(v, lambda x: x + F.lit(0).cast("float"))).alias("v")).withColumn("c", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = rows.filter("c is not null").groupBy("c").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    return rows.select("vec_id", "c"), classes


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a batch by length: length, rows, values."""
    lists = b.column("v")
    size = np.asarray(lists.value_lengths())
    values, offs = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        yield dim, own, values[offs[own][:, None] + np.arange(dim)]


def _filters(n: int, least: float, with_sketch: bool):
    """filter for each vector and cap; with c and the vector's sketch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            c = np.asarray(b.column("c"))
            for dim, own, x in _by_length(b):
                u = unit(x)
                r, f = decode(padded(u), *plan(max(4, dim), n, least))
                f = f | (dim << 44)
                if not with_sketch:
                    yield pa.RecordBatch.from_arrays([pa.array(f)], names=["filter"])
                    continue
                raw = sketches(u)
                for i in range(0, len(r), 8192):
                    p = r[i : i + 8192]
                    bytes_ = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer((np.arange(len(p) + 1) * (dim + 8)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[p]))])
                    yield pa.RecordBatch.from_arrays([pa.array(f[i : i + 8192]), pa.array(c[own[p]]), bytes_], names=["filter", "c", "sketch"])

    return run


def _tiles(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """side, whole and the ranges of rows of tiles that hold more than one."""
    tile, side, whole = (np.asarray(t.column(k)) for k in ("tile", "side", "whole"))
    edges = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True])
    return side, whole, [(a, z) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if z - a > 1]


def _screen(least: float):
    """Runs of equal tiles to the rows that may have a partner there, by their sketches."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(it, "tile"):
            side, whole, ranges = _tiles(t)
            raw, met = t.column("sketch").combine_chunks(), np.zeros(t.num_rows, bool)
            if isinstance(raw, pa.ChunkedArray):
                raw = raw.chunk(0)
            offs = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8)
            for a, z in ranges:
                m = data[offs[a] : offs[z]].reshape(z - a, -1)
                head = np.ascontiguousarray(m[:, :8]).view(np.float32)
                v = m[:, 8:].view(np.int8).astype(np.float32) * head[:, :1]
                e = head[:, 1]
                # Products are off by at most e_i + e_j + e_i e_j, and by rounding.
                near = v @ v.T + (e[:, None] + e[None, :] + e[:, None] * e[None, :]) >= np.float32(least - 1e-5)
                if whole[a]:
                    np.fill_diagonal(near, False)
                else:
                    near &= side[a:z, None] != side[None, a:z]
                met[a:z] = near.any(1)
            if met.any():
                yield pa.RecordBatch.from_arrays([t.column(k).filter(pa.array(met)).combine_chunks() for k in ("tile", "filter", "c", "side", "whole")], names=["tile", "filter", "c", "side", "whole"])

    return run


def _meet(n: int, least: float):
    """Runs of equal tiles to c, links (copies that c links with there), root (the smallest c of its component there)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(it, "tile"):
            filters, c, copies = (np.asarray(t.column(k)) for k in ("filter", "c", "copies"))
            side, whole, ranges = _tiles(t)
            vectors, before = [None] * t.num_rows, [None] * t.num_rows
            for dim, own, x in _by_length(t.combine_chunks().to_batches()[0]):
                u = unit(x)
                r, f = decode(padded(u), *plan(max(4, dim), n, least))
                edges = np.searchsorted(r, np.arange(len(u) + 1))
                for k, row in enumerate(own.tolist()):
                    vectors[row], before[row] = u[k], f[edges[k] : edges[k + 1]]
            out: list[np.ndarray] = []
            for a, z in ranges:
                u = np.stack(vectors[a:z])
                near = np.triu(u @ u.T >= least, 1)
                if not whole[a]:
                    near &= side[a:z, None] != side[None, a:z]
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                used, back = np.unique(np.r_[i, j], return_inverse=True)
                i, j = back[: len(i)], back[len(i) :]
                # Pairs that share an earlier filter were counted there.
                own = filters[a] & ((1 << 44) - 1)
                lists = [f[: np.searchsorted(f, own)] for f in (before[a + k] for k in used)]
                ids, at = np.unique(np.concatenate(lists), return_inverse=True)
                if len(ids):
                    held = np.zeros((len(used), len(ids)), np.float32)
                    held[np.repeat(np.arange(len(used)), [len(x) for x in lists]), at] = 1
                    fresh = (held @ held.T)[i, j] == 0
                    i, j = i[fresh], j[fresh]
                if not len(i):
                    continue
                own, weight = c[a + used], copies[a + used]
                links = np.bincount(i, weights=weight[j], minlength=len(used)) + np.bincount(j, weights=weight[i], minlength=len(used))
                root = own.copy()
                while True:
                    was = root.copy()
                    lo = np.minimum(root[i], root[j])
                    np.minimum.at(root, i, lo)
                    np.minimum.at(root, j, lo)
                    if (root == was).all():
                        break
                some = links > 0
                out.append(np.stack([own[some], links[some].astype(np.int64), root[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, 1)], names=["c", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    small_batches(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows, classes = valid_classes(vectors, id_col, vector_col)
    classes = scratch.keep(classes)
    n = classes.count()
    counts = classes.select("c", "v").mapInArrow(tidy(_filters(n, least, False)), "filter long").groupBy("filter").count()
    large = scratch.keep(counts.filter(F.col("count") > TILE).select("filter", F.ceil(F.col("count") / TILE).cast("int").alias("parts")))
    caps = classes.select("c", "v").mapInArrow(tidy(_filters(n, least, True)), "filter long, c long, sketch binary")
    dealt = caps.join(large, "filter", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.hash("c"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.xxhash64("filter", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "filter", "c", "sketch", (F.col("own") <= F.col("other")).alias("side"), (F.col("own") == F.col("other")).alias("whole")
    )
    by_tile = lambda x: x.repartition("tile").sortWithinPartitions("tile")
    suspects = scratch.keep(by_tile(dealt).mapInArrow(tidy(_screen(least)), "tile long, filter long, c long, side boolean, whole boolean"))
    met = scratch.keep(by_tile(suspects.join(classes.select("c", "copies", "v"), "c")).mapInArrow(tidy(_meet(n, least)), "c long, links long, root long"))
    scratch.drop(suspects)
    comp = components(met.select("c", "root"), scratch)
    links = met.groupBy("c").agg(F.sum("links").alias("links"))
    named = classes.select("c", "first", "copies").join(links, "c", "left").join(comp.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    named = scratch.keep(named)
    smallest = scratch.keep(named.groupBy("component").agg(F.min("first").alias("component_id")))
    named = named.join(smallest, "component").select("c", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    some = rows.filter("c is not null").join(named, "c").select("vec_id", "n_links", "component_id")
    none = rows.filter("c is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
