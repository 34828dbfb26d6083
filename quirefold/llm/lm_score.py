"""LM scoring: context-tree weighting over bytes, beside a unigram model over words.

The tree's contexts are the DEPTH bytes before a byte, latest first; a byte is eight binary
decisions from its highest bit on, each with its own tree. Every node has a Krichevsky-Trofimov
estimate, and each inner node weighs its own estimate against what its children make of the same
data by half and half, which gives code lengths per byte that mix all depths. The training texts
count as the past; scores are taken with the tree as it then is.

Counting: texts are dealt into blocks of about BLOCK bytes. A block sums its (DEPTH + 1)-byte
sequences and its words, cut into shards, more of them the more text there is: of sequences by a
hash of the last three bytes of their contexts, of words by their hashes. Every context seen once
is in the tree, whatever the size of the corpus; what is gathered grows with it, and stays in the
shards. Of contexts of two bytes or fewer, which alone have nodes in more than one shard, the
shards add up counts and what longer contexts make of the data; the weights are worked out on the
driver and broadcast. There are 65,793 such contexts at most.

Scoring: a block asks each shard for its distinct sequences and words by a shuffle, a shard
answers with the probabilities and counts, and the block's texts are scored where the answers meet.

Cases: null counts as an empty text, which is one end token and one end byte; without training
texts all words are unknown and every bit has one half; repeated rows count as often as they
stand; null ids count as training texts (crc32 of an empty text); ties play no part; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import WordHashes, bounded_batches, chunks, keep, runs_of, tidied, utf8

DEPTH = 5
SPLIT = 2  # contexts of more bytes lie in one shard, those of so many and fewer in several
SHARD = 4 << 20  # bytes of text a shard
LEAST_SHARDS, MOST_SHARDS = 64, 1 << 16
BLOCK = 32 << 20
END = 0xFF  # not a byte of UTF-8
_KEPT = 0xFE  # in the table of sequences, says that the context itself is in the tree


def sequences(texts: list[bytes]) -> np.ndarray:
    """(contexts << 8 | byte) of every byte of the texts and their ends; the latest byte of a context is the highest."""
    raw = np.frombuffer(b"".join(bytes([END]) * DEPTH + x + bytes([END]) for x in texts), np.uint8)
    size = np.array([len(x) + 1 for x in texts])
    start = np.cumsum(size + DEPTH) - (size + DEPTH) + DEPTH
    at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    key = raw[at].astype(np.uint64)
    for d in range(1, DEPTH + 1):
        key |= raw[at - d].astype(np.uint64) << np.uint64(8 * (DEPTH - d + 1))
    return key


def packed(x: np.ndarray) -> bytes:
    """Whole numbers with equal bytes side by side, compressed; small and similar ones take a byte or less."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unpacked(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class Sums:
    """Counts by key, added up as they come; memory follows the distinct keys."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.late: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.late.append((keys, n))
        self.size += len(keys)
        if self.size > max(2_000_000, len(self.keys)):
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and their sums so far."""
        if self.late:
            self.keys, self.n = summed(np.concatenate([self.keys, *[x for x, _ in self.late]]), np.concatenate([self.n, *[y for _, y in self.late]]))
            self.late, self.size = [], 0
        return self.keys, self.n


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov estimate of a zeros and b ones."""
    return _gamma(a + 0.5) + _gamma(b + 0.5) - _gamma(a + b + 1.0) - np.log(np.pi)


def _gamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, by Stirling's series after a shift by eight."""
    x = np.asarray(x, np.float64)
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def _cut(keys: np.ndarray, d: int) -> np.ndarray:
    """(context of d bytes << 8 | byte)."""
    return keys >> np.uint64(8 * (DEPTH - d + 1)) << np.uint64(8) | keys & np.uint64(0xFF)


def _grams(keys: np.ndarray, n: np.ndarray, first: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth first..DEPTH the sorted (context << 8 | byte) and their counts."""
    return [summed(_cut(keys, d), n) for d in range(first, DEPTH + 1)]


def _nodes(grams: list, level: int) -> list[tuple[np.ndarray, ...]]:
    """For each depth: node keys, their zeros and ones, and for each sequence its node and bit."""
    shift = np.uint64(8 - level)
    depth = []
    for keys, n in grams:
        node, one = keys >> shift, (keys >> (shift - np.uint64(1)) & np.uint64(1)).astype(bool)
        fresh = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.zeros(0, bool)
        first, of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        add = lambda v, first=first: np.add.reduceat(v, first) if len(first) else v[:0]
        depth.append((node[first], add(np.where(one, 0, n)).astype(float), add(np.where(one, n, 0)).astype(float), of, one))
    return depth


def _parent(node: np.ndarray, level: int) -> np.ndarray:
    """Keys of the nodes whose context is a byte shorter."""
    return node >> np.uint64(level + 8) << np.uint64(level) | node & np.uint64((1 << level) - 1)


def _up(depth: list, level: int, whole: np.ndarray | None = None) -> tuple[list, list, np.ndarray]:
    """Places of the parents, weights of the nodes' own estimates, and what the shortest contexts make of all their data; whole: what the longest do."""
    parents: list = [None] + [np.searchsorted(depth[d - 1][0], _parent(depth[d][0], level)) for d in range(1, len(depth))]
    own: list = [None] * len(depth)
    if whole is None:
        whole = _kt(depth[-1][1], depth[-1][2])
    for d in range(len(depth) - 2, -1, -1):
        mine = _kt(depth[d][1], depth[d][2])
        whole = np.logaddexp(mine, np.bincount(parents[d + 1], whole, len(mine))) - np.log(2)
        own[d] = np.exp(np.minimum(mine - np.log(2) - whole, 0))
    return parents, own, whole


def _down(depth: list, parents: list, own: list, given: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth: the probability of a one if no longer context is known, what shorter contexts contribute, and the weight that is left."""
    for d, (_, a, b, *_) in enumerate(depth):
        if d:
            p = parents[d]
            given, left = (given + left * own[d - 1] * estimate)[p], (left * (1 - own[d - 1]))[p]  # noqa: F821
        estimate = (b + 0.5) / (a + b + 1)
        yield np.clip(given + left * estimate, 1e-9, 1 - 1e-9), given, left


class Top:
    """The contexts of up to SPLIT bytes, whose nodes are in several shards."""

    def __init__(self, parts: list[list[tuple[np.ndarray, ...]]]):
        """parts: of each shard, for each level, its part of the nodes of SPLIT bytes: keys, zeros, ones, what longer contexts make of their data."""
        self.nodes: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(SPLIT + 1)]
        self.inner: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(8):
            keys, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *[p[level][0] for p in parts]]), return_inverse=True)
            a, b, longer = (np.bincount(back, np.concatenate([np.zeros(0), *[p[level][i] for p in parts]]), len(keys)) for i in (1, 2, 3))
            depth: list = [(keys, a, b)]
            for _ in range(SPLIT):
                k, back = np.unique(_parent(depth[0][0], level), return_inverse=True)
                depth.insert(0, (k, *(np.bincount(back, x, len(k)) for x in depth[0][1:])))
            mine = _kt(a, b)
            whole = np.logaddexp(mine, longer) - np.log(2)
            parents, own, _ = _up(depth, level, whole)
            own[SPLIT] = np.exp(np.minimum(mine - np.log(2) - whole, 0))
            root = np.zeros(len(depth[0][0]))
            for d, (p, given, left) in enumerate(_down(depth, parents, own, root, root + 1)):
                self.nodes[d].append((depth[d][0], p.astype(np.float32)))
            self.inner.append((keys, given + left * own[SPLIT] * (b + 0.5) / (a + b + 1), left * (1 - own[SPLIT])))

    @staticmethod
    def part(keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """A shard's part of the nodes of SPLIT bytes, of its whole sequences."""
        grams, out = _grams(keys, n, SPLIT), []
        for level in range(8):
            depth = _nodes(grams, level)
            parents = np.searchsorted(depth[0][0], _parent(depth[1][0], level))
            out.append((*depth[0][:3], np.bincount(parents, _up(depth[1:], level)[2], len(depth[0][0]))))
        return out


class Table:
    """A hash table of distinct keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(10, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << self.bits, np.float32)
        slot, wait = self._slot(keys), np.arange(len(keys))
        while len(wait):
            free = self.keys[slot[wait]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[slot[wait[free]]] = keys[wait[free]]  # of rivals for a slot the last one gets it
            won = self.keys[slot[wait]] == keys[wait]
            self.values[slot[wait[won]]] = values[wait[won]]
            wait = wait[~won]
            slot[wait] = (slot[wait] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and whether each key is there."""
        slot = self._slot(keys)
        got = self.keys[slot]
        found = got == keys
        value = self.values[slot]
        wait = np.flatnonzero(~found & (got != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(wait):
            slot[wait] = (slot[wait] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[wait]]
            hit = got == keys[wait]
            value[wait[hit]] = self.values[slot[wait[hit]]]
            found[wait[hit]] = True
            wait = wait[~hit & (got != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return value, found


class Tree:
    """The trees of all eight bits, as sorted nodes per depth and bit, and a hash table of whole sequences; with a top, those of one shard."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, top: Top | None = None):
        """keys, n: distinct whole sequences in order and their counts."""
        start = SPLIT + 1 if top else 0
        grams = _grams(keys, n, start)
        self.nodes: list[list[tuple[np.ndarray, np.ndarray]]] = [*(top.nodes if top else []), *[[] for _ in grams]]
        bits = [np.zeros(len(k)) for k, _ in grams]
        for level in range(8):
            depth = _nodes(grams, level)
            parents, own, _ = _up(depth, level)
            given, left = np.zeros(len(depth[0][0])), np.ones(len(depth[0][0]))
            if top:
                inner, given, left = top.inner[level]
                at = np.searchsorted(inner, _parent(depth[0][0], level))
                given, left = given[at], left[at]
            for d, (p, *_) in enumerate(_down(depth, parents, own, given, left)):
                node, _, _, of, one = depth[d]
                self.nodes[start + d].append((node, p.astype(np.float32)))
                bits[d] += np.log2(np.where(one, p[of], 1 - p[of]))
        names, values = [], []
        for d, (k, _) in enumerate(grams):
            tag = np.uint64(start + d) << np.uint64(56)
            c = np.unique(k >> np.uint64(8)) << np.uint64(8)
            names += [k | tag, c | np.uint64(_KEPT) | tag]
            values += [bits[d], np.zeros(len(c))]
        self.table = Table(np.concatenate(names), np.concatenate(values).astype(np.float32))

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """log2 of the probability of each byte after its context."""
        out = np.zeros(len(keys))
        wait, odd = np.arange(len(keys)), []
        for d in range(len(self.nodes) - 1, -1, -1):
            k = _cut(keys[wait], d) | np.uint64(d) << np.uint64(56)
            value, found = self.table.find(k)
            out[wait[found]] = value[found]
            wait, k = wait[~found], k[~found]
            _, known = self.table.find(k & ~np.uint64(0xFF) | np.uint64(_KEPT))
            odd.append(wait[known])
            wait = wait[~known]
            if not len(wait):
                break
        odd.append(wait)
        at = np.concatenate(odd)
        if len(at):
            distinct, back = np.unique(keys[at], return_inverse=True)
            out[at] = self._by_bits(distinct)[back]
        return out

    def _by_bits(self, keys: np.ndarray) -> np.ndarray:
        """Each bit at the longest context whose tree has its node; one half where none has."""
        total = np.zeros(len(keys))
        for level in range(8):
            p, done = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
            for d in range(len(self.nodes) - 1, -1, -1):
                node, prob = self.nodes[d][level]
                if not len(node):
                    continue
                k = _cut(keys, d) >> np.uint64(8 - level)
                i = np.minimum(np.searchsorted(node, k), len(node) - 1)
                new = (node[i] == k) & ~done
                p[new] = prob[i[new]]
                done |= new
            one = (keys >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
            total += np.log2(np.where(one, p, 1 - p))
        return total

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text with its end."""
        size = np.array([len(x) + 1 for x in texts])
        return np.add.reduceat(self.log2(sequences(texts)), np.cumsum(size) - size) * np.log10(2)


def _lowered(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    yield from chunks((x.lower() for x in utf8(batch.column(column))), most)


def _rows(block: int, what: int, shards: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A block's keys and counts, a row per shard; shards follow the order of the words."""
    shard = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32) if what else _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
    rows = [(s, packed(np.diff(keys[order[i:j]], prepend=np.uint64(0)).astype("<u8")), packed(n[order[i:j]].astype("<u4")), bool(n[order[i:j]].any())) for s, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)) if j > i]
    shards, k, c, learned = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([block] * len(rows)), pa.array([what] * len(rows), pa.int32()), pa.array(shards, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary()), pa.array(learned), *[pa.nulls(len(rows), pa.binary())] * 2], _BLOCKS)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the last SPLIT + 1 bytes of the contexts."""
    return ((keys >> np.uint64(8 * (DEPTH - SPLIT))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shards)


def shards_for(size: int) -> int:
    """How many shards so many bytes of text are cut into, a power of two."""
    return min(MOST_SHARDS, max(LEAST_SHARDS, 1 << (-(-size // SHARD) - 1).bit_length()))


def _keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, "<u8"), dtype=np.uint64)


_BLOCKS = ["block", "what", "shard", "keys", "n", "learned", "docs", "texts"]
_BLOCK_TYPES = "block bigint, what int, shard int, keys binary, n binary, learned boolean, docs binary, texts binary"
_SEQUENCES, _WORDS = 0, 1


def blocks(df: DataFrame, train: Column, id_col: str, text_col: str, shards: int = LEAST_SHARDS) -> DataFrame:
    """Per block of texts a row of its documents, and a row per shard of its distinct sequences and of its words, with their counts in texts where train holds."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number = WordHashes(), TaskContext.get().partitionId() << 32
        held, texts, size, parts = {_SEQUENCES: Sums(), _WORDS: Sums()}, [], 0, []

        def block() -> Iterator[pa.RecordBatch]:
            for what, sums in held.items():
                yield _rows(number, what, shards, *sums.all())
            ids = pa.chunked_array(parts).combine_chunks()
            docs = _stream(ids, np.array([len(x) for x in texts]))
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.binary())] * 2, pa.nulls(1, pa.bool_()), pa.array([docs], pa.binary()), pa.array([body], pa.binary())], _BLOCKS)

        for b in batches:
            learns = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for at, some in _lowered(b, 1):
                for learn in (True, False):
                    those = [x for x, y in zip(some, learns[at : at + len(some)], strict=True) if y == learn]
                    if those:
                        for what, keys in ((_SEQUENCES, sequences(those)), (_WORDS, seen.of([w for x in those for w in (*x.split(), b"")]))):  # the empty word is the end
                            keys.sort()
                            cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                            held[what].add(keys[cut], np.diff(cut, append=len(keys)) * learn)
                texts += some
                parts.append(b.column(0).slice(at, len(some)))
                size += sum(map(len, some))
                if size >= BLOCK:
                    yield from block()
                    number += 1
                    held, texts, size, parts = {_SEQUENCES: Sums(), _WORDS: Sums()}, [], 0, []
        if texts:
            yield from block()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("learn"))
    return keep(rows.mapInArrow(tidied(run), _BLOCK_TYPES), "uncompressed")


def _dealt(df: DataFrame, least: int, *keys: str) -> DataFrame:
    """By keys into as many partitions as are set, or more: what a task reads must not grow with the corpus."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def learned(parts: DataFrame, shards: int = LEAST_SHARDS) -> DataFrame:
    """(what, shard, keys, n, total, distinct, top): the sums of all blocks; top: a shard's nodes of SPLIT bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ["what", "shard"]):
            sums = Sums()
            for k, n in zip(t.column("keys"), t.column("n"), strict=True):
                n = unpacked(n.as_py(), "<u4").astype(np.int64)
                sums.add(_keys(k.as_py())[n > 0], n[n > 0])
            keys, n = sums.all()
            what = t.column("what")[0].as_py()
            top = pickle.dumps(Top.part(keys, n)) if what == _SEQUENCES else None
            row = [what], [t.column("shard")[0].as_py()], [packed(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))], [packed(n.astype("<i8"))], [int(n.sum())], [len(n)], [top]
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["what", "shard", "keys", "n", "total", "distinct", "top"])

    d = _dealt(parts.filter("learned").select("what", "shard", "keys", "n"), shards, "what", "shard").sortWithinPartitions("what", "shard")
    return keep(d.mapInArrow(tidied(run), "what int, shard int, keys binary, n binary, total bigint, distinct bigint, top binary"), "uncompressed")


def _top(model: DataFrame) -> Top:
    return Top([pickle.loads(r.top) for r in model.filter("top is not null").select("top").toLocalIterator()])


def grow(train: DataFrame) -> Tree:
    """The tree of all rows of train (text) in one piece, in this process; scored() leaves it in its shards."""
    sums = Sums()
    for r in learned(blocks(train, F.lit(True), "text", "text")).filter(F.col("what") == _SEQUENCES).toLocalIterator():
        sums.add(_keys(r["keys"]), unpacked(r["n"], "<i8"))
    return Tree(*sums.all())


def answered(parts: DataFrame, model: DataFrame, shards: int) -> DataFrame:
    """(block, what, shard, keys, got): log2 of the probabilities of a block's sequences, and how often its words were learned."""
    top = parts.sparkSession.sparkContext.broadcast(_top(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, n, tree = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        for b in batches:
            for block, what, shard, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (what, shard) != now:
                    now, keys, n, tree = (what, shard), np.zeros(0, np.uint64), np.zeros(0, np.int64), None
                if block is None:
                    keys, n = _keys(k), unpacked(c, "<i8")
                    continue
                asked = _keys(k)
                if what == _WORDS:
                    at = np.searchsorted(keys, asked)
                    known = np.concatenate([keys, [np.uint64(0)]])[at] == asked
                    got = np.where(known & (at < len(keys)), np.concatenate([n, [0]])[at], 0).astype("<i8")
                    k = None
                else:
                    tree = tree or Tree(keys, n, top.value)
                    got = tree.log2(asked).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([what], pa.int32()), pa.array([shard], pa.int32()), pa.array([k], pa.binary()), pa.array([packed(got)], pa.binary())], ["block", "what", "shard", "keys", "got"])

    asks = parts.filter("what is not null").select("block", "what", "shard", "keys", F.lit(None).cast("binary").alias("n"))
    both = model.select(F.lit(None).cast("bigint").alias("block"), "what", "shard", "keys", "n").unionByName(asks)
    ordered = _dealt(both, shards, "what", "shard").sortWithinPartitions("what", "shard", F.col("block").asc_nulls_first())
    return ordered.mapInArrow(tidied(run), "block bigint, what int, shard int, keys binary, got binary")


def _stream(ids: pa.Array, size: np.ndarray) -> bytes:
    """A block's documents as one value."""
    rows = pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64())], ["id", "size"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_batch(rows)
    return out.getvalue().to_pybytes()


def scored(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    train: a condition on the columns of df; rows where it holds are learned from.
    """
    kind = df.schema[id_col].dataType.simpleString()
    size = df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    shards = shards_for(size)
    parts = blocks(df, train, id_col, text_col, shards)
    model = learned(parts, shards)
    total, distinct = model.filter(F.col("what") == _WORDS).agg(F.sum("total"), F.sum("distinct")).first()
    total, below = total or 0, (total or 0) + 0.5 * ((distinct or 0) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, values, counts = WordHashes(), [], [], []
        for b in batches:
            for what, k, got, docs, texts in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if what == _SEQUENCES:
                    keys.append(_keys(k))
                    values.append(unpacked(got, "<f4"))
                elif what == _WORDS:
                    counts.append(unpacked(got, "<i8"))
                else:
                    yield from score(seen, Table(np.concatenate(keys), np.concatenate(values)), np.concatenate(counts), docs, texts)
                    keys, values, counts = [], [], []

    def score(seen: WordHashes, table: Table, count: np.ndarray, docs: bytes, texts: bytes) -> Iterator[pa.RecordBatch]:
        held = pa.ipc.open_stream(docs).read_all()
        ids, size = held.column(0).combine_chunks(), held.column(1).to_numpy()
        raw = memoryview(zstandard.ZstdDecompressor().decompress(texts))
        end = np.cumsum(size)
        each = [(at, some) for at, some in chunks((bytes(raw[j - n : j]) for j, n in zip(end.tolist(), size.tolist(), strict=True)), 2 << 20)]
        h = [[seen.of([*x.split(), b""]) for x in some] for _, some in each]
        distinct = np.unique(np.concatenate([y for x in h for y in x]))  # in the order of the shards' answers
        value = np.log10((count + 0.5) / below)
        for (at, some), words in zip(each, h, strict=True):
            n = np.array([len(x) for x in words])
            start = np.cumsum(n) - n
            token = np.searchsorted(distinct, np.concatenate(words))
            long = size[at : at + len(some)] + 1
            bits, _ = table.find(sequences(some))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, len(some)), pa.array(long - 1), pa.array(n, pa.int64()), pa.array(np.add.reduceat((count > 0)[token].astype(np.int64), start)),
                    pa.array(np.add.reduceat(value[token], start)), pa.array(np.add.reduceat(bits.astype(np.float64), np.cumsum(long) - long) * np.log10(2)),
                ],
                ["id", "n_bytes", "n_tokens", "n_known", "base_score", "score"],
            )

    answers = answered(parts, model, shards).unionByName(parts.filter("what is null").select("block", "docs", "texts"), allowMissingColumns=True)
    ordered = _dealt(answers, shards, "block").sortWithinPartitions("block", F.col("what").asc_nulls_last(), "shard")
    out = ordered.select("what", "keys", "got", "docs", "texts").mapInArrow(tidied(run), f"id {kind}, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    bits = -F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)
    return out.select("id", "n_bytes", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
