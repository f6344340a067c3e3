"""Byte-pair encoding and decoding in numpy, a batch of texts at a time.

The symbols of many words lie in one flat array. In each round the ranks of all neighbouring pairs are
found by binary search over the sorted pair keys, and every word merges its lowest-ranked pair; words
without a pair that can merge leave the array. All places of that pair merge in the same round where
this gives what one merge at a time from the left gives; of the few pairs where it might not (the merged
symbol has a merge of a lower rank) only the first place merges.

Texts are cut into words as the byte-level pre-tokenizer cuts them. A bounded cache keeps the ids of
chunks seen before. Defined results: null and empty texts have no ids; the strings of special tokens in a
text become their ids, as the tokenizers library does; ids that are unknown or null decode to nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rolegraph.llm.common import batches, small_batches, table, tidy

#: The pattern of byte-level BPE's words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RARE_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n\t\r"]
MARKS = frozenset(".,;:!?|")
#: Chunks that a worker's cache keeps.
CACHE = 200_000
NONE = np.int64(1 << 40)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable bytes stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each s and n, one after the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class BytePairs:
    """Vocabulary, sorted pair keys, and special tokens of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        alphabet = byte_alphabet()
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.first = np.array([vocab[c] for c in alphabet], np.int64)
        self.last = np.array([vocab[c + suffix] for c in alphabet], np.int64)
        back = {c: b for b, c in enumerate(alphabet)}
        strings = [b""] * (self.size + 1)  # the last stands for unknown ids
        for t, i in vocab.items():
            strings[i] = bytes(back[c] for c in t.removesuffix(suffix)) + b" " * (suffix != "" and t.endswith(suffix))
        for t, i in self.special.items():
            strings[i] = t.encode()
        self.bytes_length = np.array([len(s) for s in strings], np.int64)
        self.bytes_start = np.cumsum(self.bytes_length) - self.bytes_length
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], order.astype(np.int64), merged[order]
        lowest = np.full(self.size, NONE)
        for part in (left, right):
            np.minimum.at(lowest, part, np.arange(len(pairs)))
        self.one_by_one = lowest[self.merged] < self.rank

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        sym, ends = self.first[data], np.cumsum(lengths) - 1
        sym[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        rank, into = self.look_up(sym[:-1], sym[1:], word[:-1] == word[1:])
        while len(sym):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            each = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.r_[begin, len(sym)]))
            ready = each == NONE
            if ready.any():
                done_sym.append(sym[ready])
                done_word.append(word[ready])
            chosen = np.flatnonzero((rank == each) & ~ready)
            if not len(chosen):
                break
            # Places that touch are of one pair (a, a): every second one merges.
            run_begin = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1] + 1])
            run = np.repeat(run_begin, np.diff(np.r_[run_begin, len(chosen)]))
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            single = self.one_by_one[into[chosen]]
            if single.any():  # the first place in each word
                w = word[chosen]
                chosen = chosen[~single | np.r_[True, w[1:] != w[:-1]]]
            sym[chosen] = self.merged[into[chosen]]
            keep = ~ready
            keep[chosen + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[chosen] = True
            sym, word, rank, into, changed = sym[keep], word[keep], rank[keep], into[keep], changed[keep]
            # Only pairs with a new symbol are looked up again.
            changed[:-1] |= changed[1:]
            at = np.flatnonzero(changed)
            rank[at[-1:]] = NONE
            at = at[at < len(sym) - 1]
            rank[at], into[at] = (x[:-1] for x in self.look_up(sym[at], sym[at + 1], word[at] == word[at + 1]))
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def look_up(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (or NONE) and its place among the sorted keys; one more at the end, without a pair."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        rank = np.where((self.keys[at] == key) & same, self.rank[at], NONE)
        return np.append(rank, NONE), np.append(at, 0)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and how many each has."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        n = self.bytes_length[ids]
        return gather(self.bytes, self.bytes_start[ids], n), n


class Chunks(dict):
    """Numbers chunks as they come; those that are new wait until they are encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Encoder:
    def __init__(self, path: str):
        self.pairs = BytePairs(path)
        self.word = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.pairs.special)) + ")") if self.pairs.special else None
        self.reset()

    def reset(self) -> None:
        self.chunks, self.ids, self.start, self.count = Chunks(), np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0

    def keys(self, text: str) -> list[str]:
        """A key that begins with a space stands for what follows it, another for itself after a space."""
        touching = len(text.split()) - 1 != sum(map(text.count, " \n\t\r"))  # or at an end of the text
        if touching or any(c in text for c in RARE_SPACES):
            return [" " + w for w in self.word.findall(text)]
        first, *rest = text.split(" ")
        return [" " + first, *rest]

    def words(self, key: str) -> list[str] | None:
        if key.isascii():  # most chunks are a word, or a word and a mark
            if key.isalpha():
                return [" " + key]
            if key[-1:] in MARKS and key[:-1].isalpha():
                return [" " + key[:-1], key[-1]]
        return self.word.findall(key[1:] if key[0] == " " else " " + key)

    def learn(self) -> None:
        """Encode the chunks that wait."""
        words, of, others = [], [], []
        for n, key in enumerate(self.chunks.new):
            found = self.words(key)
            if found is None:
                others.append(n)
            else:
                words += found
                of += [n] * len(found)
        ids, n = self.pairs.merge([w.encode() for w in words])
        count = np.bincount(np.array(of, np.int64), weights=n, minlength=len(self.chunks.new)).astype(np.int64)
        if others:
            ids, count = self.with_others(ids, count, others)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start = np.concatenate([self.start, self.used + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used += len(ids)
        self.chunks.new.clear()

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        if len(self.chunks) > CACHE or self.used > 8 * CACHE:
            self.reset()
        numbers, sizes = [], []
        for text in texts:
            n = 0
            if text:
                parts = self.split.split(text) if self.split and any(s in text for s in self.pairs.special) else [text]
                for k, part in enumerate(parts):
                    if k % 2:
                        numbers.append(np.array([-1 - self.pairs.special[part]]))
                        n += 1
                    elif part:
                        keys = self.keys(part)
                        numbers.append(np.fromiter(map(self.chunks.__getitem__, keys), np.int64, len(keys)))
                        n += len(keys)
            sizes.append(n)
        if self.chunks.new:
            self.learn()
        at = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        whole = np.cumsum(np.r_[0, sizes])
        count = np.ones(len(at), np.int64)
        known = at >= 0
        count[known] = self.count[at[known]]
        starts = np.zeros(len(at), np.int64)
        starts[known] = self.start[at[known]]
        out = gather(self.ids, starts, count)
        if not known.all():
            out[(np.cumsum(count) - count)[~known]] = -1 - at[~known]
        sums = np.r_[0, np.cumsum(count)]
        return out, np.diff(sums[whole])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)


def slices(offs: np.ndarray, rows: int, target: int = 1 << 18) -> list[tuple[int, int]]:
    """Ranges of rows of about target values each."""
    out, i = [], 0
    while i < rows:
        j = min(rows, max(i + 1, int(np.searchsorted(offs, offs[i] + target, "right")) - 1))
        out.append((i, j))
        i = j
    return out


def encode(df: DataFrame, path: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """df with the ids of its texts in the new column `into`; path: a tokenizers JSON file on every machine."""
    small_batches(df.sparkSession)
    names = df.columns
    if into in names:
        raise ValueError(f"column {into} exists")

    def run(it):
        e = encoder(path)
        for b in it:
            texts = b.column(names.index(text_col)).cast(pa.large_string())
            offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            for i, j in slices(offs, b.num_rows):
                ids, n = e.encode(texts.slice(i, j - i).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), lists], names=[*names, into])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """df with its ids' text in the new column `into`; bytes that are not UTF-8 become U+FFFD."""
    small_batches(df.sparkSession)
    names = df.columns
    if into in names:
        raise ValueError(f"column {into} exists")

    def run(it):
        p = encoder(path).pairs
        for b in it:
            texts = [t.decode("utf-8", "replace") for t in decoded_rows(p, b.column(names.index(ids_col)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, into])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(into, T.StringType())]))


def decoded_rows(p: BytePairs, lists: pa.Array) -> Iterable[bytes]:
    offs = lists.offsets.to_numpy()
    values = lists.values.fill_null(-1).to_numpy().astype(np.int64)
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    for i, j in slices(offs, len(lists)):
        flat, n = p.decode(values[offs[i] : offs[j]])
        ends = np.r_[0, np.cumsum(n)][offs[i : j + 1] - offs[i]]
        flat = flat.tobytes()
        for k in range(j - i):
            yield flat[ends[k] : ends[k + 1]] if valid[i + k] else b""


def digests(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids as decimals joined by commas and of the decoded text."""
    names = df.columns

    def of(b: pa.RecordBatch) -> list:
        p = encoder(path).pairs
        lists = b.column(names.index(ids_col))
        offs, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        decimals = [hashlib.sha256(",".join(map(str, values[a:z].tolist())).encode()).hexdigest() for a, z in zip(offs[:-1], offs[1:], strict=True)]
        texts = [hashlib.sha256(t if _valid(t) else t.decode("utf-8", "replace").encode()).hexdigest() for t in decoded_rows(p, lists)]
        return [b.column(names.index(id_col)), np.diff(offs), decimals, texts]

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return df.mapInArrow(batches(of, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _valid(b: bytes) -> bool:
    try:
        b.decode()
    except UnicodeDecodeError:
        return False
    return True


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or byte_bpe_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, path).select("doc_id", "ids"), path)
