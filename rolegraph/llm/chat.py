r"""Conversations formatted into training windows under a token budget.

Rows arrive sorted by conversation and turn and are formatted as a stream, so no conversation is held
whole. Prefix sums of the turns' tokens choose spans of whole turns that fit the budget. Every window
begins with the conversation's system turn, then repeats whole turns of limited history, then has its new
turns; the loss mask covers the texts of new assistant turns, so each is a target once.

The template is `<|im_start|>role\ntext<|im_end|>\n`. Inside roles and texts a backslash is doubled, and one
is put after the first character of every control string, so that none is left; readers undo this.

Defined results: null roles and texts are empty; a turn over the budget has a window of its own; rows with
equal turn numbers go by role and text; null turns come first; null conv_ids form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.llm.bpe import byte_bpe_path, encoder
from rolegraph.llm.common import small_batches, table, tidy

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and other common templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_FIND = re.compile("([" + re.escape("".join(sorted({c[0] for c in CONTROL}))) + "])(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_UNDO = re.compile(r"\\(.)", re.DOTALL)
#: Turns and characters that are held until they are formatted.
HELD_TURNS, HELD_CHARS = 1024, 1 << 20
WINDOWS = "conv_id long, window_id long, text string, loss array<struct<start:int,end:int>>, n_turns long, n_repeated long, n_tokens long"


def escape(text: str) -> str:
    return _FIND.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNDO.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def turn_text(role: str, text: str) -> str:
    return f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}"


def read_turns(window: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted window."""
    turns = (t.removeprefix(START).split("\n", 1) for t in window.split(END)[:-1])
    return [(unescape(role), unescape(text)) for role, text in turns]


class Conversation:
    """Takes one conversation's turns in order and makes its windows."""

    def __init__(self, conv_id: int | None, budget: int, history: int, count):
        self.conv_id, self.budget, self.history, self.count = conv_id, budget, history, count
        self.system: tuple[str, int] | None = None
        self.past: list[tuple[str, str, int]] = []  # formatted turns of the history, newest last
        self.new: list[tuple[str, str]] = []
        self.chars = self.windows = 0
        self.begun = False

    def add(self, role: str, text: str) -> Iterator[tuple]:
        self.new.append((role, text))
        self.chars += len(text)
        if len(self.new) >= HELD_TURNS or self.chars >= HELD_CHARS:
            yield from self.spans(final=False)

    def spans(self, final: bool) -> Iterator[tuple]:
        """Windows over the held turns; the last stays held unless final, as more turns might fit."""
        past = self.past
        formatted = [(role, turn_text(role, text)) for role, text in self.new]
        turns = past + [(r, t, n) for (r, t), n in zip(formatted, self.count([t for _, t in formatted]), strict=True)]
        i = len(past)
        if not self.begun and turns:
            self.begun = True
            if turns[0][0] == "system":
                self.system = turns[0][1:]
                if len(turns) == 1 and final:
                    yield self.window(turns, 0, 0, 1)
                    return
                turns[0] = (*turns[0][:2], 0)  # it is in every window, so here it costs nothing
        sums = np.r_[0, np.cumsum([n for _, _, n in turns])].astype(np.int64)
        room = self.budget - (self.system[1] if self.system else 0)
        done = i
        while i < len(turns):
            first = int(np.searchsorted(sums, sums[i] - self.history, "left"))
            if sums[i + 1] - sums[first] > room:
                first = i  # the turn leaves no room for history
            j = max(i + 1, int(np.searchsorted(sums, sums[first] + room, "right")) - 1)
            if j >= len(turns) and not final:
                break
            yield self.window(turns, first, i, min(j, len(turns)))
            i = done = min(j, len(turns))
        first = int(np.searchsorted(sums, sums[done] - self.history, "left"))
        self.past = turns[first:done]
        self.new = self.new[done - len(past) :]
        self.chars = sum(len(t) for _, t in self.new)

    def window(self, turns: list, first: int, i: int, j: int) -> tuple:
        parts, loss, at, repeated = [], [], 0, 0
        own = self.windows == 0 and self.system is not None  # the first window has the system turn as a new one
        if self.system and not own:
            parts.append(self.system[0])
            at, repeated = len(self.system[0]), 1
        tokens = self.system[1] if self.system else 0
        for k in range(first, j):
            role, text, n = turns[k]
            if self.system and n == 0 and text == self.system[0] and not (own and k == 0):
                continue  # the system turn, which the window has already
            if k < i:
                repeated += 1
            elif role == "assistant":
                loss.append((at + text.index("\n") + 1, at + len(text) - len(END)))
            parts.append(text)
            at += len(text)
            tokens += n
        self.windows += 1
        return self.conv_id, self.windows - 1, "".join(parts), [{"start": a, "end": z} for a, z in loss], len(parts), repeated, tokens


def format_chat(turns: DataFrame, budget: int = 2048, history: int = 256, tokenizer: str | None = None) -> DataFrame:
    """Windows of all conversations (columns: WINDOWS); positions of the loss mask are code points of text.

    turns: conv_id, turn, role, text. budget, history: tokens of a window and of its repeated turns, as
    counted by the tokenizers JSON file `tokenizer`.
    """
    small_batches(turns.sparkSession)
    path = tokenizer or byte_bpe_path()
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in re.sub("<.*>", "", WINDOWS).split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = lambda texts: encoder(path).encode(texts)[1]
        now: Conversation | None = None
        for b in it:
            out: list[tuple] = []
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        out += now.spans(final=True)
                    now = Conversation(conv, budget, history, count)
                out += now.add(role or "", text or "")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if now is not None and (out := list(now.spans(final=True))):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(tidy(run), WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of what the windows of format_chat() hold, a row for each conversation; windows must lie in order."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def row() -> tuple:
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        for b in it:
            out = []
            for conv, text, loss, repeated in zip(*(b.column(k).to_pylist() for k in ("conv_id", "text", "loss", "n_repeated")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
            if out:
                yield batch(out)
        if state is not None:
            yield batch([row()])

    return windows.select("conv_id", "text", "loss", "n_repeated").mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return read_back(format_chat(turns.unionByName(extra)))
