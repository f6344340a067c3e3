"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

A text's blocks for a template are all its windows of SPREAD times as many words as the template has, one from
every word on, so a notice is found wherever it begins, also with as many foreign words among its own. A block
matches a template when it holds at least a given share of the template's distinct words. Template words are
ordered by how often the whole corpus has them, rarest first; a match must hold a word of the template's prefix
(prefix filter), so only rows that have one are looked at; they must have words enough (length filter) and, from
their rarest common word on, leave enough of the template (positional filter). For what remains, the words of
every block are counted exactly: a word counts for the blocks that end between it and its next occurrence.

Defined results: null and empty texts have no words and no labels. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.llm.common import Words, byte_values, row_groups, small_batches, table, text_buffer, tidy

#: Phrases whose presence alone gives a label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices by label, from one line to whole license texts.
TEMPLATES = [
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
        "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd-3",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties "
        "of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
    ),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
]
#: A block has so many times the words of the template.
SPREAD = 2
#: What is no part of a word, after A-Z became a-z.
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
VALUES = byte_values()


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), SEPARATORS, VALUES).hashes


def blocks_of_rows(b: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    """Words of a few rows at a time."""
    data, offs = text_buffer(b.column("text"))
    for i, j in row_groups(offs):
        yield i, j, Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], SEPARATORS, VALUES)


def token_counts(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[int, int]:
    """How often the corpus has each word of the templates, by hash; as many rows as the templates have words."""
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(word_hashes(t) for _, t in templates)]))
    if not len(known):
        return {}

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for b in it:
            for _, _, w in blocks_of_rows(b):
                at = np.minimum(np.searchsorted(known, w.hashes), len(known) - 1)
                total += np.bincount(at[known[at] == w.hashes], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], names=["token", "n"])

    found = docs.select("text").mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = {int(r.token) & (1 << 64) - 1: int(r.n) for r in found.collect()}
    return {int(h): counts.get(int(h), 0) for h in known}


class Templates:
    """Templates as ranks in the global order of their words, rarest first."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[int, int], threshold: float):
        order = sorted(counts, key=lambda h: (counts[h], h))
        rank = {h: r for r, h in enumerate(order)}
        self.sorted = np.array(sorted(order), np.uint64)
        self.rank = np.array([rank[int(h)] for h in self.sorted], np.int64)
        self.labels = [label for label, _ in templates]
        words = [[rank[int(h)] for h in word_hashes(t)] for _, t in templates]
        self.block = [SPREAD * len(w) for w in words]
        self.sets = [np.unique(w) for w in words]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        #: The place of each rank in each template, or -1.
        self.place = np.full((len(templates), len(order) + 1), -1)
        for t, s in enumerate(self.sets):
            self.place[t, s] = np.arange(len(s))

    def matches(self, w: Words) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Rows, template, and the largest share in a block of each row, for each template that a block of theirs matches."""
        if not len(self.sorted):
            return
        at = np.minimum(np.searchsorted(self.sorted, w.hashes), len(self.sorted) - 1)
        words = np.flatnonzero(self.sorted[at] == w.hashes)
        ranks = self.rank[at[words]]
        rows = np.searchsorted(w.rows, words, "right") - 1
        size = np.diff(w.rows)
        for t, (s, need) in enumerate(zip(self.sets, self.need, strict=True)):
            place = self.place[t, ranks]
            maybe = np.zeros(len(size), bool)
            maybe[rows[(place >= 0) & (place <= len(s) - need)]] = True  # prefix and position: the rarest common word leaves enough
            maybe &= size >= need
            if not maybe.any():
                continue
            own = np.flatnonzero((place >= 0) & maybe[rows])
            row, word, begin = rows[own], place[own], words[own]
            # Where each word occurs next in its row.
            order = np.lexsort((begin, word, row))
            same = (row[order][1:] == row[order][:-1]) & (word[order][1:] == word[order][:-1])
            end = np.minimum(begin + self.block[t], w.rows[row + 1])
            end[order[:-1][same]] = np.minimum(end[order[:-1][same]], begin[order[1:][same]])
            # Blocks that end at a word hold as many words as began and did not end up to there.
            ends = np.sort(end)
            held = np.arange(1, len(own) + 1) - np.searchsorted(ends, begin, "right")
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            most = np.maximum.reduceat(held, first)
            hit = most >= need
            if hit.any():
                yield row[first[hit]], t, most[hit] / len(s)


def scan(docs: DataFrame, threshold: float = 0.9, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    score is the largest share of a template that a block holds, among matches; 1 where a phrase stands.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = Templates(templates, token_counts(texts, templates), threshold)
    sought = [(word_hashes(p), label) for p, label in phrases.items()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j, w in blocks_of_rows(b):
                n = j - i
                n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base, labels, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
                h = w.hashes
                for p, label in sought:
                    at = np.flatnonzero(h[: len(h) - len(p) + 1] == p[0]) if len(h) >= len(p) else np.zeros(0, np.int64)
                    for k in range(1, len(p)):
                        at = at[h[at + k] == p[k]]
                    row = np.searchsorted(w.rows, at, "right") - 1
                    inside = at + len(p) <= w.rows[row + 1]
                    at, row = at[inside], row[inside]
                    np.add.at(n_base, row, 1)
                    np.minimum.at(first, row, at - w.rows[row])
                    np.maximum.at(last, row, at - w.rows[row])
                    for r in set(row.tolist()):
                        base[r].add(label)
                        score[r] = 1.0
                for rows, t, share in known.matches(w):
                    score[rows] = np.maximum(score[rows], share)
                    for row in rows.tolist():
                        labels[row].add(known.labels[t])
                none = n_base == 0
                join = lambda x: [",".join(sorted(s)) for s in x]
                columns = [b.column("doc_id").slice(i, n), np.diff(w.rows), n_base, pa.array(first, mask=none), pa.array(last, mask=none), join(base), join([x | y for x, y in zip(base, labels, strict=True)]), score]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return texts.mapInArrow(tidy(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
