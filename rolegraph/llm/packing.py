"""Documents packed into training sequences, online, by the sum-of-squares rule.

Whole windows of a long document are sequences of their own. What is left of it goes where it makes the
sum of the squared counts of open windows by fill level smallest; the counts are one array with an entry
for each level. Each task packs its own rows as they come, however many windows are open. At the end of a task the
open windows fill each other up, and the last one is cut into lengths that are powers of two, so that no sequence
needs padding.

Open windows hold their ids, in two bytes each where the vocabulary allows it: of a task at most what its rows have,
and never more than HELD bytes, for at that size the windows are filled up as at the end of a task and new ones begin.

Ids are those of the tokenizers library: words of Latin-1 text are merged here, others by the library.
Defined results: null and empty texts have only the end id; rows with equal doc_ids are separate documents.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from rolegraph.llm.bpe import MARKS, RARE_SPACES, Encoder, slices
from rolegraph.llm.common import small_batches, table, tidy

WINDOW, END_ID = 4096, 2
#: Bytes of ids in open windows at which a task fills them up and begins anew.
HELD = 256 << 20
#: The pattern of the tokenizer's words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder(Encoder):
    """Ids of a tokenizer that drops white space, lower-cases and marks word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.word, self.whole = regex.compile(WORD), Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.split = None  # special tokens have no white space, so they lie within a chunk

    def keys(self, text: str) -> list[str]:
        if any(c in text for c in RARE_SPACES):
            return regex.split("[ \t\r\n]+", text)
        return text.split()

    def words(self, key: str) -> list[str] | None:
        """None if the library must encode the chunk: letters that Unicode composes or that change their length, or special tokens."""
        if key.isascii() or max(key) <= "\xff":  # most chunks are a word, or a word and a mark
            if key.isalpha():
                return [key.lower()]
            if key[-1:] in MARKS and key[:-1].isalpha():
                return [key[:-1].lower(), key[-1]]
        if "<|" in key or not key.isprintable() or (not key.isascii() and max(key) > "\xff"):
            return None
        return self.word.findall(key.lower())

    def with_others(self, ids: np.ndarray, count: np.ndarray, others: list[int]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.whole.encode_batch([self.chunks.new[n] for n in others], add_special_tokens=False)]
        sums = np.r_[0, np.cumsum(count)]
        parts, at = [], 0
        for n, own in zip(others, found, strict=True):
            parts += [ids[at : sums[n]], np.array(own, np.int64)]
            at = sums[n]
            count[n] = len(own)
        return np.concatenate([*parts, ids[at:]]), count


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class SumOfSquares:
    """Online packing; sequences that are full are in `out` as lists of (doc, start, ids)."""

    def __init__(self, window: int = WINDOW, held: int = HELD):
        self.window, self.most_held = window, held
        self.counts = np.zeros(window + 1, np.int64)
        self.at_level: dict[int, list[list]] = {}
        self.open = self.held = 0
        self.out: list[list] = []

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        self.out += [[(doc, s, ids[s : s + self.window])] for s in range(0, whole, self.window)]
        if whole < len(ids):
            self.place(doc, whole, ids[whole:].copy() if whole else ids)
            if self.held > self.most_held:
                self.close()

    def place(self, doc, start: int, ids: np.ndarray) -> None:
        size, n = len(ids), self.counts
        # Change of the sum of squares for each level below: one window less there, one more at the new level.
        before, after = n[1 : self.window - size + 1], n[1 + size : self.window + 1]
        change = 2 * (after - before) + 2
        if len(change):
            change[-1] = 1 - 2 * before[-1]  # a full window counts no more
            change[before == 0] = 1 << 40
        fresh = 2 * int(n[size]) + 1
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else 0
        if len(change) and change[best] < 1 << 40 and change[best] <= fresh:
            self.put(self.take(best + 1), best + 1, doc, start, ids)
        else:
            self.put([], 0, doc, start, ids)

    def take(self, level: int) -> list:
        window = self.at_level[level].pop()
        self.counts[level] -= 1
        self.open -= 1
        self.held -= sum(p[2].nbytes for p in window)
        return window

    def put(self, window: list, level: int, doc, start: int, ids: np.ndarray) -> None:
        window.append((doc, start, ids))
        level += len(ids)
        if level == self.window:
            self.out.append(window)
            return
        self.at_level.setdefault(level, []).append(window)
        self.counts[level] += 1
        self.open += 1
        self.held += sum(p[2].nbytes for p in window)

    def close(self) -> None:
        """Fill the open windows from the emptiest ones; the last is cut at powers of two."""
        rest = deque((level, w) for level in np.flatnonzero(self.counts).tolist() for w in self.at_level[level])
        self.counts[:] = self.open = self.held = 0
        self.at_level.clear()
        spare: list[tuple] = []
        while rest:
            level, window = rest.pop()
            while level < self.window and (spare or rest):
                if not spare:
                    spare = rest.popleft()[1]
                doc, start, ids = spare.pop()
                room = self.window - level
                window.append((doc, start, ids[:room]))
                level += min(room, len(ids))
                if room < len(ids):
                    spare.append((doc, start + room, ids[room:]))
            if level == self.window:
                self.out.append(window)
            else:
                spare, rest = window, ()
        while left := sum(len(p[2]) for p in spare):
            size, part = 1 << (left.bit_length() - 1), []
            while size:
                doc, start, ids = spare.pop()
                part.append((doc, start, ids[:size]))
                if len(ids) > size:
                    spare.append((doc, start + size, ids[size:]))
                size -= min(size, len(ids))
            self.out.append(part)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences (columns: PIECES, and ids array<int> on request).

    A sequence is a window or shorter; all shorter ones have a power of two as length.
    """
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
    types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = word_encoder(tokenizer), SumOfSquares(window)
        encode, kind = encoder.encode, "<u2" if max(encoder.whole.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        sequence = TaskContext.get().partitionId() << 40

        def pieces() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for parts in packer.out:
                offset = 0
                for (doc_id, tokens), start, ids in parts:
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4")), tokens, sequence, offset, *([ids.tolist()] * with_ids)))
                    offset += len(ids)
                sequence += 1
            packer.out.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in it:
            texts = b.column(1).cast(pa.large_string())
            offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            for i, j in slices(offs, b.num_rows):
                ids, n = encode(texts.slice(i, j - i).to_pylist())
                ends = np.cumsum(n)
                for doc_id, a, z in zip(b.column(0).slice(i, j - i).to_pylist(), (ends - n).tolist(), ends.tolist(), strict=True):
                    own = np.empty(z - a + 1, kind)
                    own[:-1], own[-1] = ids[a:z], end_id
                    packer.add((doc_id, len(own)), own)
                yield from pieces()
        packer.close()
        yield from pieces()

    return docs.selectExpr(f"cast(`{id_col}` as long)", f"cast(`{text_col}` as string)").mapInArrow(tidy(run), PIECES + ", ids array<int>" * with_ids)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer or word_bpe_path())
