"""Bounded samples of labelled documents, for fitting classifiers.

Defined results: null texts and labels give no example; rows that agree in text and label are one example; other
columns of either table are not read; empty tables give no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: dict[int, int], most_chars: int) -> list[tuple[str, int]]:
    """Text and label of at most most[label] documents of each label, chosen by a hash of doc_id.

    Only rows of labels that are `allowed` count. Documents of more than most_chars characters are no
    examples (they are scored whole like all others). The sample's size does not depend on the input's.
    """
    marks = labels.filter(allowed).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    chosen = None
    for value, n in most.items():
        part = marks.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    # chosen has at most sum(most) rows of two numbers.
    own = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= most_chars)
    table = own.join(F.broadcast(chosen), "id").select("text", "label").toArrow()
    return sorted(set(zip(table.column("text").to_pylist(), table.column("label").to_pylist(), strict=True)))
