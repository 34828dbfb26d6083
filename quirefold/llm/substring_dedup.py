"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics.

A corpus is compared with itself, so every document against every shard would grow with its
square. Anchors route instead: a window's anchor is the smallest hash of the k-word sequences in
it, which depends on nothing but the window's words, so equal windows have equal anchors. Anchors
that occur once are done with. Every other anchor has a home, the first place (row, block of
BLOCK words) that it occurs in. The homes' windows are the reference shards, of bounded size each:
a suffix automaton over exact words, replicated to the groups of documents that share an anchor
with it. Those stream through it; matching statistics give the longest match that ends at each
word, and matches of at least `length` words mark the window in the document and in the reference.
Windows that repeat inside a shard are read off the automaton itself.

What a document shares with others but not with the anchor's home matches nowhere there; all its
occurrences have the same anchor and are left over alike, and an exact count of the left-over
windows (128-bit digests) decides about them.

A home with many documents is split by a salt over several groups, each with its own automaton;
hot anchors are joined by broadcast, fewer than HOT_ONE_IN of them by definition.

Cases: null texts have no words; texts shorter than a window never change; rows that repeat a
document are occurrences of their own; windows may overlap themselves; ids may be null or repeat;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import WordHashes, bounded_batches, chunks, ids_hint, join_facts, keep, mix, tidied, utf8

BLOCK = 20_000
QUERIES_A_GROUP = 1000


def _powers(x: np.ndarray, width: int, join) -> np.ndarray:
    """join over all runs of width consecutive values, by doubling."""
    parts, step, at, out = x, 1, 0, None
    while True:
        if width & step:
            if out is None:
                out, at = parts, step
            else:
                n = min(len(out), len(parts) - at)
                out, at = join(out[:n], parts[at : at + n]), at + step
        if 2 * step > width:
            return out
        parts = join(parts[:-step], parts[step:]) if len(parts) > step else parts[:0]
        step *= 2


def anchors(h: np.ndarray, length: int, k: int) -> np.ndarray:
    """The anchor of each window of `length` words; empty if there is no window."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    return _powers(grams(h, k), length - k + 1, np.minimum)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all sequences of k words."""
    return _powers(mix(h), k, lambda a, b: mix(a * np.uint64(0x9E3779B97F4A7C15) + b))


def runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of windows with the same anchor."""
    cuts = np.flatnonzero(m[1:] != m[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(m)]])


class Automaton:
    """Suffix automaton of word sequences. Distinct separators stand between the segments."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first, self.at = [-1], [0], [-1], []

    def extend(self, words: list) -> None:
        nxt, link, length, first, at = self.next, self.link, self.length, self.first, self.at
        last = at[-1] if at else 0
        for w in words:
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            first.append(len(at))
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            at.append(new)
            last = new

    def separate(self) -> None:
        self.extend([len(self.at)])  # a number is never a word

    def repeated(self, least: int) -> list[int]:
        """Positions at which a sequence of at least so many words ends that also ends elsewhere here."""
        inner = set(self.link)
        length, link = self.length, self.link
        return [i for i, s in enumerate(self.at) if (length[s] if s in inner else length[link[s]]) >= least]

    def stream(self, words: list, least: int) -> list[tuple[int, int]]:
        """(position in words, position here) of the ends of matches of at least so many words."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        v = n = 0
        out = []
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
                if n >= least:
                    out.append((i, first[v]))
        return out


def spans(ends: list[int], length: int) -> list[tuple[int, int]]:
    """Ranges covered by windows that end at the given positions, in order."""
    out: list[tuple[int, int]] = []
    for e in sorted(ends):
        s = e - length + 1
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], e + 1)
        else:
            out.append((s, e + 1))
    return out


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _table(df: DataFrame, length: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_words, sha, text, anchors): what a document is if nothing is removed, and its anchors."""
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    entry = pa.struct([("g", pa.int64()), ("block", pa.int32()), ("times", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for b in batches:
            for at, texts in chunks(utf8(b.column(1))):
                n, sha, offsets, flat = [], [], [0], [[], [], []]
                for x in texts:
                    words = x.split()
                    n.append(len(words))
                    sha.append(_digest(words))
                    h = seen.of(words)
                    m = anchors(h, length, k)
                    if len(m):
                        starts, _ = runs(m)
                        value, where = np.unique(m[starts], return_index=True)
                        every = np.sort(grams(h, k))
                        twice = np.isin(value, every[1:][every[1:] == every[:-1]])
                        flat[0].append(value.astype("<u8").view("<i8"))
                        flat[1].append((starts[where] // BLOCK).astype(np.int32))
                        flat[2].append(np.where(twice, 2, 1).astype(np.int32))
                        offsets.append(offsets[-1] + len(value))
                    else:
                        offsets.append(offsets[-1])
                cols = [pa.array(np.concatenate(c) if c else [], t.type) for c, t in zip(flat, entry, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(entry)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(sha), pa.array(texts, pa.binary()), lists], ["id", "n_words", "sha", "text", "anchors"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), f"id {kind}, n_words bigint, sha string, text binary, anchors array<struct<g:bigint,block:int,times:int>>")
    return keep(out.withColumn("row", F.monotonically_increasing_id()))


def _segments(routed: DataFrame, length: int, k: int) -> DataFrame:
    """Rows (row, text, homes) cut into runs of windows that go to the same home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for b in batches:
            out: list[tuple] = []
            for row, text, homes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.split()
                to = {x["g"]: (x["home"], x["block"]) for x in homes}
                m = anchors(seen.of(words), length, k)
                starts, ends = runs(m)
                now, begun, over = None, 0, 0
                for g, s, e in [*zip(m[starts].astype("<u8").view("<i8").tolist(), starts.tolist(), ends.tolist(), strict=True), (None, len(m), len(m))]:
                    home = to.get(g)
                    target = home and (*home, not (home[0] == row and home[1] == s // BLOCK))
                    if target != now:
                        if now:
                            out.append((*now, row, begun, b" ".join(words[begun : over + length - 1])))
                        now, begun = target, s
                    over = e
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["home", "block", "query", "row", "start", "words"])

    return routed.select("row", "text", "homes").mapInArrow(tidied(run), "home bigint, block int, query boolean, row bigint, start bigint, words binary")


def _matched(segments: DataFrame, length: int) -> DataFrame:
    """Streams the segments of each home through its automaton: marks (row, s, e, null) and left-over
    windows (row, s, e, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, machine, origin, hits, out, size = None, Automaton(), [], set(), [], 0

        def close() -> None:
            """The reference's own marks: position by position back to rows and words."""
            if key is None:
                return
            if key[2] == 0:
                hits.update(machine.repeated(length))
            for first, last, row, start in origin:
                ends = [p - first + start for p in range(first, last) if p in hits] if hits else []
                out.extend((row, s, e, None) for s, e in spans(ends, length))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["row", "s", "e", "w"])

        for b in batches:
            for home, block, salt, query, row, start, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (home, block, salt) != key:
                    close()
                    key, machine, origin, hits = (home, block, salt), Automaton(), [], set()
                words = text.split(b" ")
                if not query:
                    if origin:
                        machine.separate()
                    origin.append((len(machine.at), len(machine.at) + len(words), row, start))
                    machine.extend(words)
                    continue
                got = machine.stream(words, length)
                hits.update(p for _, p in got)
                ends = [i for i, _ in got]
                out.extend((row, s + start, e + start, None) for s, e in spans(ends, length))
                for i in sorted(set(range(length - 1, len(words))).difference(ends)):
                    out.append((row, start + i - length + 1, start + i + 1, xxhash.xxh3_128_digest(b" ".join(words[i - length + 1 : i + 1]))))
            if len(out) > 20_000:
                yield flush()
                out = []
        close()
        if out:
            yield flush()

    ordered = segments.repartition("home", "block", "salt").sortWithinPartitions("home", "block", "salt", "query", "row", "start")
    return ordered.select("home", "block", "salt", "query", "row", "start", "words").mapInArrow(tidied(run), "row bigint, s bigint, e bigint, w binary")


def removed(df: DataFrame, length: int = 50, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of df: id, n_words, n_removed, kept_sha256, and the kept text on request.

    Each word goes that is covered by a window of `length` words that also starts anywhere else;
    windows are judged on the input. k is the anchors' length in words.
    """
    k = k or max(1, length // 3)
    t = _table(df, length, k, id_col, text_col)
    places = t.select("row", F.explode("anchors").alias("a")).select("row", "a.*")
    facts = keep(places.groupBy("g").agg(F.sum("times").alias("times"), F.count("*").alias("rows"), F.min(F.struct("row", "block")).alias("home")).filter("times > 1").select("g", "rows", F.col("home.row").alias("home"), F.col("home.block").alias("home_block")))
    total = t.agg(F.sum(F.size("anchors"))).first()[0] or 0
    homes = join_facts(places.select("row", "g"), facts, "g", "rows", total)
    homes = keep(homes.groupBy("row").agg(F.collect_list(F.struct("g", "home", F.col("home_block").alias("block"))).alias("homes")))
    rows = homes.select("row")
    routed = t.select("row", "text").join(ids_hint(rows, homes.count()), "row", "left_semi").join(homes, "row")
    segments = keep(_segments(routed, length, k))

    # homes with many documents are split; their reference goes to each part
    many = segments.filter("query").groupBy("home", "block").count().filter(F.col("count") > QUERIES_A_GROUP)
    many = keep(many.select("home", "block", F.expr(f"count div {QUERIES_A_GROUP} + 1").cast("int").alias("parts")))
    salted = segments.join(ids_hint(many, many.count()), ["home", "block"], "left").fillna({"parts": 1})
    spread = F.when(F.col("query"), F.array(F.pmod(F.xxhash64("row", "start"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    found = keep(_matched(salted.withColumn("salt", F.explode(spread)), length))

    left = found.filter("w is not null")
    again = keep(left.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1"))
    late = join_facts(left, again, "w", "n", found.count()).select("row", "s", "e")
    marks = found.filter("w is null").select("row", "s", "e").unionByName(late)
    marks = keep(marks.groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("marks")))
    return _result(t, marks, with_text)


def _result(t: DataFrame, marks: DataFrame, with_text: bool) -> DataFrame:
    kind = t.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, kept = [], [], [], []
            for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.split()
                stay = np.ones(len(words), bool)
                for r in ranges:
                    stay[r["s"] : r["e"]] = False
                rest = [words[i] for i in np.flatnonzero(stay)]
                n.append(len(words))
                gone.append(len(words) - len(rest))
                sha.append(_digest(rest))
                kept.append(b" ".join(rest).decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    rows, n = marks.select("row"), marks.count()
    touched = t.select("row", "id", "text").join(ids_hint(rows, n), "row", "left_semi")
    changed = touched.join(marks, "row").select("id", "text", "marks").mapInArrow(tidied(run), schema)
    words = F.regexp_replace(F.decode("text", "UTF-8"), r"[\x20\x09-\x0D]+", " ")
    same = t.join(ids_hint(rows, n), "row", "left_anti").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.trim(words).alias("kept") if with_text else F.lit(None).cast("string").alias("kept"))
    out = changed.unionByName(same)
    return out if with_text else out.drop("kept")
