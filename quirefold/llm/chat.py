"""Chat formatting in budgeted windows, and its reader.

Conversations are cut into windows of whole turns: prefix sums of turn tokens decide where the next
window starts. Every window repeats the system turn and up to `history` turns before it, as far as
half of the budget allows; what is repeated is never a target, so each assistant text is under the
loss mask exactly once. A turn longer than the budget stands in a window of its own, whole.

Template: <|turn|>role<|says|>text<|end|>. Inside roles and texts a backslash is doubled and every
occurrence of a control string is broken up by backslash-dot behind its first character, so
nothing inside a text can read as markup, and unescape() restores it.

Rows stream through in the order of (conversation, turn): memory is bounded by a window, whatever
a conversation's length. Cases: null roles and texts count as empty; null turns come first; rows
that repeat a turn are turns of their own, ordered by role and text; null conv_id is one
conversation; an empty table has no windows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import bounded_batches, tidied

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
# Strings that public chat templates use as markup.
CONTROL = (TURN, SAYS, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<start_of_turn>", "<end_of_turn>")
_FIND = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_BACK = re.compile(r"\\([\\.])")
_READ = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _FIND.sub(r"\1\\.", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: "\\" if m[1] == "\\" else "", text)


@lru_cache(1)
def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(vocabulary: str | None) -> Callable[[str], int]:
    """Tokens of a text: by a vocabulary of ranks, whose path is given, else its bytes divided by four."""
    if vocabulary is None:
        return lambda t: -(-len(t.encode()) // 4)
    encode = _ranks(vocabulary).encode_ordinary
    # pieces of bounded length: the pattern is quadratic on endless runs without a boundary
    return lambda t: sum(len(encode(t[i : i + 100_000])) for i in range(0, len(t), 100_000))


class Windows:
    """Turns of one conversation in, finished windows out."""

    def __init__(self, count: Callable[[str], int], budget: int, history: int):
        self.count, self.budget, self.history = count, budget, history
        self.system: tuple[str, int] | None = None
        self.past: deque[tuple[str, int]] = deque(maxlen=max(history, 0))
        self.head: list[tuple[str, int]] = []
        self.body: list[tuple[str, int, int, int]] = []  # formatted, tokens, target's start and length within it
        self.prefix = self.base = 0  # prefix sums of tokens: of all turns, and before this window's first
        self.number = self.seen = 0

    def _open(self) -> None:
        """What the next window repeats: the system turn, then as much of the latest turns as half of the budget holds."""
        self.head = [self.system] if self.system and self.seen else []
        left, tail = self.budget // 2 - sum(n for _, n in self.head), []
        for turn in reversed(self.past):
            if turn is not self.system:
                if (left := left - turn[1]) < 0:
                    break
                tail.append(turn)
        self.head += reversed(tail)
        self.base = self.prefix

    def close(self) -> dict | None:
        if not self.body:
            return None
        parts, spans = [t for t, _ in self.head], []
        at = sum(map(len, parts))
        for text, _, start, length in self.body:
            if start >= 0:
                spans.append((at + start, at + start + length))
            parts.append(text)
            at += len(text)
        tokens = sum(n for _, n in self.head) + self.prefix - self.base
        out = {"window": self.number, "text": "".join(parts), "context_turns": len(self.head), "new_turns": len(self.body), "tokens": tokens, "loss": spans}
        self.number, self.body = self.number + 1, []
        return out

    def add(self, role: str, text: str) -> dict | None:
        """The window that this turn closes, if any."""
        inside = escape(text)
        lead = f"{TURN}{escape(role)}{SAYS}"
        turn = (f"{lead}{inside}{END}", self.count(text) + self.count(role) + 3)
        done = None
        if self.body and sum(n for _, n in self.head) + self.prefix - self.base + turn[1] > self.budget:
            done = self.close()
        if not self.body:
            self._open()
            while self.head and sum(n for _, n in self.head) + turn[1] > self.budget:
                # the oldest history goes first, the system turn last and only if the turn can't fit beside it
                if self.head[0] is self.system and len(self.head) > 1:
                    self.head.pop(1)
                elif self.head[0] is self.system:
                    break
                else:
                    self.head.pop(0)
        self.prefix += turn[1]
        self.body.append((*turn, len(lead) if role == "assistant" else -1, len(inside)))
        if role == "system" and self.system is None:
            self.system = turn
        elif self.history:
            self.past.append(turn)
        self.seen += 1
        return done


def windows(df: DataFrame, budget: int = 512, history: int = 2, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, window, text, context_turns, new_turns, tokens, loss): loss holds [start, end) ranges of text."""
    bounded_batches(df.sparkSession)
    kind = df.schema["conv_id"].dataType.simpleString()
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    names = ["conv_id", "window", "text", "context_turns", "new_turns", "tokens", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, now, key, rows, size = counter(vocabulary), None, None, [], 0
        id_type = pa.int64()

        def flush() -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pair)]
            cols = [[r[n] for r in rows] for n in names[:-1]] + [[[{"start": s, "end": e} for s, e in r["loss"]] for r in rows]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        def put(window: dict | None) -> None:
            nonlocal size
            if window:
                rows.append(window | {"conv_id": key})
                size += len(window["text"])

        for b in batches:
            id_type = b.schema.field(0).type
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if now is None or conv != key:
                    if now:
                        put(now.close())
                    now, key = Windows(count, budget, history), conv
                put(now.add(role or "", text or ""))
                if size > 4 << 20:
                    yield flush()
                    rows, size = [], 0
        if now:
            put(now.close())
        if rows:
            yield flush()

    ordered = df.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(tidied(run), f"conv_id {kind}, window bigint, text string, context_turns bigint, new_turns bigint, tokens bigint, loss array<struct<start:bigint,end:bigint>>")


def read(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _READ.findall(text)]


def summary(formatted: DataFrame) -> DataFrame:
    """What the windows say when they are read again, one row a conversation.

    The windows of a conversation come in order, as windows() leaves them.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows, id_type, begun = None, None, [], pa.int64(), False

        def put() -> None:
            rows.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        def flush() -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for b in batches:
            id_type = b.schema.field(0).type
            for conv, text, context, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not begun or conv != key:
                    if begun:
                        put()
                    key, state, begun = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], True
                for role, said in read(text)[context:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
                state[5] += 1
            if len(rows) > 5000:
                yield flush()
                rows = []
        if begun:
            put()
        if rows:
            yield flush()

    return formatted.select("conv_id", "text", "context_turns", "loss").mapInArrow(tidied(run), f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")
