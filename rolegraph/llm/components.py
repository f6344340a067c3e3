"""Connected components of a graph given as edges: contraction within tasks, and alternating large and small stars.

Defined results: edges that hold null, loops and repeated edges add nothing; no edges give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.llm.common import Scratch, tidy

#: Edges that a task contracts at once.
BLOCK_EDGES = 1 << 18
#: So many edges, 2 MB, or fewer are finished by one task; more go through further rounds.
FINISH = 1 << 17


def stars(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The edges (u, v) as stars around the smallest node of each component: two rows, nodes and their centres."""
    ids, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = back[: len(u)], back[len(u) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if (label == before).all():
            break
    own = np.flatnonzero(label != np.arange(len(ids)))
    return np.stack([ids[own], ids[label[own]]])


def _contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, BLOCK_EDGES at once, as stars around the smallest node of their component; the graph stays connected as it is."""
    held, n = np.zeros((2, 0), np.int64), 0
    more: list[np.ndarray] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["u", "v"])

    for b in it:
        more.append(np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))]))
        n += b.num_rows
        if n >= BLOCK_EDGES:
            held, more, n = stars(*np.concatenate([held, *more], 1)), [], 0
            if held.shape[1] >= BLOCK_EDGES:
                yield batch()
                held = held[:, :0]
    held = stars(*np.concatenate([held, *more], 1))
    if held.shape[1]:
        yield batch()


def components(edges: DataFrame, scratch: Scratch | None = None, stage_bytes: float | None = None, finish: int = FINISH) -> DataFrame:
    """id, component: the smallest id that can be reached from it, for every id but those smallest ones.

    edges: two long columns. Nothing but a count and a checksum of the edges comes to the driver.
    """
    a, b = edges.columns
    scratch = scratch or Scratch(edges.sparkSession, "components")
    own = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u <> v")
    e, last = scratch.keep(own.mapInArrow(tidy(_contract), "u long, v long"), stage_bytes), None
    while True:
        n, check = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n <= finish:
            done = scratch.keep(e.coalesce(1).mapInArrow(tidy(_contract), "u long, v long"))
            break
        if (n, check) == last:
            done = e
            break
        last, before = (n, check), e
        # Small star: each node links its smaller neighbours to the smallest of them.
        least = scratch.keep(e.groupBy("u").agg(F.min("v").alias("m")))
        small = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.keep(small)
        # Large star: each node links its larger neighbours to the smallest one, or to itself.
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least_of = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        e = scratch.keep(both.join(least_of, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        scratch.drop(before, least, small, least_of)
    if done is not e:
        scratch.drop(e)
    return done.select(F.col("u").alias("id"), F.col("v").alias("component"))
