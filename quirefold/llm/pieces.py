"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a word with the space mark before it) are joined to one text and
indexed by a suffix array, sorted as far as the longest piece. Every piece is found by binary
search as a range of suffixes; the ranges are the edges of the segmentation lattice. Edges are
sorted by the offset in their unit where they end and relaxed offset by offset, all units at once;
units of more than LONG characters, which would leave the others behind, one by one.

For a BPE model the segmentation of a prefix ends in exactly one piece that may stand behind the
segmentation of what precedes it, so relaxing means to find that one: two neighbours are valid if
undoing their merges, latest first, never meets a pair across the seam that would have been merged
before. That gives the same ids as merging by rank. Pieces of space marks alone have equal, worst
ranks in such models; runs of them are merged last, from the left.

Characters without a piece become byte pieces. Decoding joins the pieces' bytes and drops the
space that encoding puts in front; U+2581 in a text reads back as a space, all else as it was.

Cases: null and empty texts have no piece; very long texts and words stay whole; repeated rows
have equal ids; an empty table gives an empty result; other columns pass through encode().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import bounded_batches, chunks, tidied, tidy, utf8

MARK = "▁"
_PACK = 4  # characters of 15 bits in a 64-bit word
_NONE = np.int64(1) << 40
UNITS = 250_000
LONG = 2000
#: Characters of units that are indexed at a time, if not one unit has more; edges take some hundred bytes a character.
SPAN = 1 << 17


def model_type(proto: bytes) -> int:
    """The kind of a serialised model (field 3 of its field 2): 1 unigram, which is the default, 2 BPE, 3 words, 4 characters."""

    def number(raw: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 0x80:
                return value, at

    def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0
        while at < len(raw):
            tag, at = number(raw, at)
            if tag & 7 == 0:
                value, at = number(raw, at)
                yield tag >> 3, value
            else:
                size, at = number(raw, at) if tag & 7 == 2 else (8 if tag & 7 == 1 else 4, at)
                yield tag >> 3, raw[at : at + size]
                at += size

    trainer = next((x for n, x in fields(proto) if n == 2), b"")
    return next((x for n, x in fields(trainer) if n == 3), 1)


class Model:
    """A BPE model's pieces, ranks, splits, and its encoder. Built from the model file by the reading library."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if model_type(sp.serialized_model_proto()) != 2:
            raise ValueError(f"{path} is not a BPE model")
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(size)]
        scores = [sp.get_score(i) for i in range(size)]
        self.byte = np.zeros(256, np.int32)
        for i in range(size):
            if sp.is_byte(i):
                self.byte[int(self.pieces[i][3:5], 16)] = i
        ids = {p: i for i, p in enumerate(self.pieces) if normal[i]}
        self.mark = ids.get(MARK, -1)
        self.marks = {len(p): i for p, i in ids.items() if set(p) == {MARK}}
        many = [p for p in ids if len(p) > 1 and set(p) != {MARK}]
        if any(MARK in p[1:] for p in many):
            raise ValueError("pieces with a space mark behind their first character are not supported")
        many.sort(key=lambda p: -scores[ids[p]])
        self.rank = np.full(size + 1, -1, np.int64)
        self.left, self.right = np.arange(size + 1), np.arange(size + 1)
        order = {p: r for r, p in enumerate(many)}
        pairs, reached = [], []
        for r, p in enumerate(many):
            parts = list(p)
            while len(parts) > 2:  # merge by rank, of equal pairs the first
                best = min(((order.get(a + b, size), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(size, 0))
                if best[0] >= r:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2 and all(x in ids for x in parts):
                a, b, i = ids[parts[0]], ids[parts[1]], ids[p]
                self.rank[i], self.left[i], self.right[i] = r, a, b
                pairs.append((a * (size + 1) + b, r))
                reached.append(p)
        self.unknown = size  # stands for a character without a piece
        self._pairs(pairs)
        self.pair, self.made = dict(pairs), (self.rank.tolist(), self.left.tolist(), self.right.tolist())
        self._side_by_side: dict[int, bool] = {}
        usable = reached + [p for p in ids if len(p) == 1]
        self.alphabet = np.array(sorted({ord(c) for p in usable for c in p}), np.int64)
        if len(self.alphabet) >= 1 << 15:
            raise ValueError("more than 32,767 different characters in pieces")
        self.longest = max(map(len, usable))
        self.words = -(-self.longest // _PACK)
        self.find_id = np.array([ids[p] for p in usable], np.int32)
        self.find_len = np.array([len(p) for p in usable])
        self.low, self.high = self._bounds(usable)
        self.length = np.ones(size + 1, np.int32)
        self.length[self.find_id] = self.find_len
        self.single = np.zeros(len(self.alphabet) + 1, bool)
        for p in usable:
            if len(p) == 1:
                self.single[1 + np.searchsorted(self.alphabet, ord(p))] = True
        inside = {c for p in reached for c in p}
        stops = "" if "\n" in inside else "\n"
        self.units = re.compile(f"{MARK}[^{MARK}{stops}]*|[^{MARK}{stops}]+" + ("|\n" if stops else ""))
        self.bytes = [p.replace(MARK, " ").encode() if normal[i] else (bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"") for i, p in enumerate(self.pieces)]

    def _pairs(self, pairs: list[tuple[int, int]]) -> None:
        self.slots = 18
        self.pair_key = np.full(1 << self.slots, -1, np.int64)
        self.pair_rank = np.full(1 << self.slots, _NONE, np.int64)
        for k, r in pairs:
            s = int(self._slot(np.array([k]))[0])
            while self.pair_key[s] >= 0:
                s = (s + 1) & ((1 << self.slots) - 1)
            self.pair_key[s], self.pair_rank[s] = k, r

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slots)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that a and b merge to."""
        k = a * (self.unknown + 1) + b
        s = self._slot(k)
        got = self.pair_key[s]
        out = np.where(got == k, self.pair_rank[s], _NONE)
        wait = np.flatnonzero((got != k) & (got >= 0))
        while len(wait):
            s[wait] = (s[wait] + 1) & ((1 << self.slots) - 1)
            got = self.pair_key[s[wait]]
            hit = got == k[wait]
            out[wait[hit]] = self.pair_rank[s[wait[hit]]]
            wait = wait[~hit & (got >= 0)]
        return out

    def valid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging by rank leaves a and b side by side."""
        ok, wait, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), _NONE)
        a, b = a.copy(), b.copy()
        while len(wait):
            c = self.merged(a, b)
            bad = c < limit
            ok[wait[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~bad & ((ra >= 0) | (rb >= 0))
            wait, a, b, ra, rb = wait[on], a[on], b[on], ra[on], rb[on]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def follows(self, a: int, b: int) -> bool:
        """valid() of one pair, remembered."""
        key = a * (self.unknown + 1) + b
        ok = self._side_by_side.get(key)
        if ok is None:
            if len(self._side_by_side) > 1_000_000:
                self._side_by_side.clear()
            ok = self._side_by_side[key] = self._stay(a, b)
        return ok

    def _stay(self, a: int, b: int) -> bool:
        rank, left, right = self.made
        limit = none = int(_NONE)
        while self.pair.get(a * (self.unknown + 1) + b, none) >= limit:
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a, limit = right[a], ra
            else:
                b, limit = left[b], rb + 1
        return False

    def relax(self, size: int, start: list[int], end: list[int], piece: list[int]) -> list[int]:
        """The last piece of the segmentation of every beginning of one unit; edges in order of their ends, the longest first."""
        last, done = [-1] * (size + 1), 0
        for s, e, this in zip(start, end, piece, strict=True):
            if e != done:
                before = last[s]
                if before < 0 or before == self.unknown or this == self.unknown or self.follows(before, this):
                    last[e], done = this, e
        return last

    def _packed(self, codes: np.ndarray) -> np.ndarray:
        """From every position on, the next _PACK codes as one number."""
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(self.words * _PACK + _PACK, np.int64)])
        out = np.zeros(n + self.words * _PACK, np.int64)
        for i in range(_PACK):
            out |= padded[i : i + len(out)] << (15 * (_PACK - 1 - i))
        return out

    def _bounds(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word of packed characters, the smallest and largest suffix that starts with each piece."""
        low = np.zeros((self.words * _PACK, len(pieces)), np.int64)
        high = np.full_like(low, (1 << 15) - 1)
        for j, p in enumerate(pieces):
            low[: len(p), j] = high[: len(p), j] = 1 + np.searchsorted(self.alphabet, [ord(c) for c in p])
        shift = np.array([15 * (_PACK - 1 - i) for i in range(_PACK)])[None, :, None]
        return (low.reshape(self.words, _PACK, -1) << shift).sum(1), (high.reshape(self.words, _PACK, -1) << shift).sum(1)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, id) of every occurrence of every piece, by suffix array and binary search."""
        packed = self._packed(codes)
        n = len(codes)
        columns = [packed[w * _PACK : w * _PACK + n] for w in range(self.words)]
        suffixes = self._sorted(columns[0])
        columns = [c[suffixes] for c in columns]
        # the first characters of all pieces at once, then those of longer ones inside what is left of them
        first, last = np.searchsorted(columns[0], self.low[0], "left"), np.searchsorted(columns[0], self.high[0], "right")
        for w in range(1, self.words):
            some = np.flatnonzero((self.find_len > w * _PACK) & (last > first))
            lo, hi = first[some], last[some]
            first[some], last[some] = self._within(columns[w], self.low[w, some], lo, hi, False), self._within(columns[w], self.high[w, some], lo, hi, True)
        count = last - first
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return suffixes.astype(np.int32)[at], np.repeat(self.find_id, count)

    @staticmethod
    def _within(column: np.ndarray, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
        """Where each key belongs in its own range of the column, which is sorted there."""
        lo, hi = lo.copy(), hi.copy()
        wait = np.flatnonzero(lo < hi)
        while len(wait):
            mid = (lo[wait] + hi[wait]) >> 1
            x, k = column[mid], keys[wait]
            less = x <= k if right else x < k
            lo[wait[less]] = mid[less] + 1
            hi[wait[~less]] = mid[~less]
            wait = wait[lo[wait] < hi[wait]]
        return lo

    def _sorted(self, first: np.ndarray) -> np.ndarray:
        """The suffix array as far as the longest piece, from the first _PACK characters on by doubling."""
        width, key = _PACK, first
        while True:
            order = np.argsort(key)
            if width >= self.longest:
                return order
            ranked = key[order]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]]))
            key = rank << 32
            key[:-width] |= rank[width:]
            width *= 2

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per unit) of distinct units; byte pieces stand for unknown characters."""
        size = np.array([len(u) for u in units])
        begin = np.cumsum(size + 1) - (size + 1)
        text = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, text), len(self.alphabet) - 1)
        codes = np.where(self.alphabet[at] == text, at + 1, 0)
        gaps = begin + size
        codes[gaps] = 0
        start, piece = self.edges(codes)
        lone = ~self.single[codes]
        lone[gaps] = False
        lone = np.flatnonzero(lone).astype(np.int32)
        start, piece = np.concatenate([start, lone]), np.concatenate([piece, np.full(len(lone), self.unknown, np.int32)])
        end = start + self.length[piece]
        unit = np.repeat(np.arange(len(units), dtype=np.int32), size + 1)
        offset = end - begin.astype(np.int32)[unit[start]]
        if offset.max(initial=0) < 1 << 19 and self.longest < 1 << 12:
            order = np.argsort(offset.astype(np.int64) << 44 | end.astype(np.int64) << 12 | 4095 - self.length[piece])
        else:  # the three don't fit into one word
            order = np.lexsort((-self.length[piece], end, offset))
        start, piece, end, offset = start[order], piece[order], end[order], offset[order]
        # last[p]: the piece that the segmentation of a unit's text up to p ends in; -1 at a unit's start
        last = np.full(len(text) + 1, -1, np.int64)
        if (long := np.flatnonzero(size > LONG)).size:
            of = unit[start]
            for u in long:
                mine, low = of == u, begin[u]
                last[low + 1 : low + size[u] + 1] = self.relax(size[u], (start[mine] - low).tolist(), (end[mine] - low).tolist(), piece[mine].tolist())[1:]
            short = size[of] <= LONG
            start, piece, end, offset = start[short], piece[short], end[short], offset[short]
        fresh = np.concatenate([[True], end[1:] != end[:-1]]) if len(end) else np.zeros(0, bool)
        heads = np.flatnonzero(fresh)
        rows = np.searchsorted(offset[heads], np.arange(1, int(offset.max()) + 2 if len(offset) else 1))
        for i, j in zip(rows, rows[1:], strict=False):
            now = heads[i:j]
            while len(now):
                before, this = last[start[now]], piece[now].astype(np.int64)
                ok = (before < 0) | (before == self.unknown) | (this == self.unknown)
                test = np.flatnonzero(~ok)
                ok[test] = self.valid(before[test], this[test])
                last[end[now[ok]]] = this[ok]
                now = now[~ok] + 1  # the next shorter piece that ends there
        used = np.zeros(len(text) + 1, bool)
        p, low = begin + size, begin
        while len(p):
            more = p > low
            p, low = p[more], low[more]
            used[p] = True
            p = p - self.length[last[p]]
        spots = np.flatnonzero(used)
        ids = last[spots]
        owner = unit[spots - 1]
        if (ids == self.unknown).any():
            raw = [chr(c).encode("utf-8", "surrogatepass") if i == self.unknown else b"" for c, i in zip(text[spots - 1].tolist(), ids.tolist(), strict=True)]
            times = np.array([len(x) or 1 for x in raw])
            where = np.cumsum(times) - times
            out = np.repeat(ids, times)
            for k in np.flatnonzero(ids == self.unknown):
                out[where[k] : where[k] + times[k]] = self.byte[list(raw[k])]
            ids, owner = out, np.repeat(owner, times)
        return ids.astype(np.int32), np.bincount(owner, minlength=len(units))

    def run(self, r: int) -> list[int]:
        """Pieces of r space marks, merged from the left."""
        most = max(self.marks, default=1)
        out, parts = [], r
        while parts > 2 * most:
            out.append(self.marks[most])
            parts -= most
        sizes = [1] * parts
        while True:
            i = next((i for i in range(len(sizes) - 1) if sizes[i] + sizes[i + 1] in self.marks), None)
            if i is None:
                return out + [self.marks[x] for x in sizes]
            sizes[i : i + 2] = [sizes[i] + sizes[i + 1]]

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """ids with neighbouring space marks merged."""
        bare = ids == self.mark
        if not (bare[1:] & bare[:-1]).any():
            return ids
        edge = np.flatnonzero(np.diff(np.concatenate([[0], bare.view(np.int8), [0]])))
        out, at = [], 0
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            out += [ids[at:s], np.array(self.run(e - s), np.int32)]
            at = e
        return np.concatenate([*out, ids[at:]])

    def decode(self, ids: np.ndarray) -> bytes:
        got = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return got[1:] if got[:1] == b" " else got


class Encoder:
    """Encodes batches; the units of late are remembered, so that each is indexed once."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.model.units.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.place) > UNITS:
            self._reset()
        new = list({u: None for s in split for u in s if u not in self.place})
        size = np.cumsum([len(u) for u in new])
        cuts = np.flatnonzero(np.diff(size // SPAN, prepend=0)).tolist()
        for i, j in zip([0, *cuts], [*cuts, len(new)], strict=True):
            if i < j:
                ids, count = self.model.segment(new[i:j])
                self.place.update(zip(new[i:j], range(len(self.place), len(self.place) + j - i), strict=True))
                self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
                self.count, self.flat = np.concatenate([self.count, count]), np.concatenate([self.flat, ids])
        out = []
        for s in split:
            u = np.fromiter(map(self.place.__getitem__, s), np.int64, len(s))
            n = self.count[u]
            at = np.repeat(self.start[u] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(self.model.runs(self.flat[at]))
        return out


@lru_cache(1)
def _model(path: str) -> Model:
    return Model(path)


def _ids(column: pa.Array, encoder: Encoder) -> Iterator[tuple[int, list[bytes], list[np.ndarray]]]:
    for at, texts in chunks(utf8(column), 1 << 20):
        yield at, texts, encoder.encode([x.decode("utf-8", "replace") for x in texts])


def encode(df: DataFrame, model_file: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """df with a column of piece ids. The model file is read by the workers, each once."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(_model(model_file))
        try:
            for t in batches:
                out: list[np.ndarray] = []
                for _, _, ids in _ids(pa.array(t, pa.string()), encoder):
                    out += ids
                yield pd.Series(out, dtype=object)
        finally:
            del encoder
            tidy()

    return df.withColumn(out_col, run(F.col(text_col)))


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of a column of piece ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        model = _model(model_file)
        return pd.Series([model.decode(np.asarray(x)).decode("utf-8", "replace") if x is not None else "" for x in t])

    return df.withColumn(out_col, run(F.col(ids_col)))


def summary(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_chars, n_ids, ids_sha256 (little-endian 32-bit ids), decoded_sha256, same (decoded equals the text)."""
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_model(model_file))
        for b in batches:
            for at, texts, ids in _ids(b.column(1), encoder):
                back = [encoder.model.decode(i) for i in ids]
                cols = [
                    pa.array([len(t.decode("utf-8", "replace")) for t in texts], pa.int64()), pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array([x == t for x, t in zip(back, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *cols], ["id", "n_chars", "n_ids", "ids_sha256", "decoded_sha256", "same"])

    schema = f"id {kind}, n_chars bigint, n_ids bigint, ids_sha256 string, decoded_sha256 string, same boolean"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), schema)
