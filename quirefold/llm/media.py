"""Media columns: Matroska written and parsed.

The parser reads variable-length EBML ids and sizes (unknown sizes too), tracks, clusters, simple
blocks and block groups, the three kinds of lacing, and cues, and gives a packet table: track,
timestamp, key flag, and the byte range of each frame in the file. The writer stores bytes as
8-bit PCM frames, laced by eight, in clusters with a cue each.

Cases: null counts as empty; an empty payload has no packet; malformed media raise ValueError in
parse() and give a row with an error in packets(), or stop the job on request; lengths are 64-bit
and nothing is cut; repeated rows give repeated packets; other columns of the table are left out
of packets() but for the id.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import bounded_batches, tidied, utf8

# Element ids of EBML and Matroska.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOCTYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, MUXER, WRITER, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACK, NUMBER, UID, TYPE, LACING, CODEC, DEFAULT_DURATION, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
MASTERS = frozenset({SEGMENT, CLUSTER})
TOP = frozenset({INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367})

FRAME, LACE, CLUSTER_BLOCKS, HERTZ = 192, 8, 40, 8000


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    size: int
    key: bool
    cluster: int
    lace: int


class Parsed(NamedTuple):
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    scale: int


def vint(b: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """Value and next position of a variable-length integer; -1 for the reserved unknown size."""
    if at >= len(b) or not b[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - b[at].bit_length()
    if at + width > len(b):
        raise ValueError(f"integer cut off at byte {at}")
    value = int.from_bytes(b[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def elements(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a range. One of unknown size lasts to the next element that can't be its child."""
    while at < end:
        of, at = vint(b, at, True)
        size, at = vint(b, at, False)
        if size < 0:
            if of not in MASTERS:
                raise ValueError(f"element {of:x} has no size")
            stop, ends = at, TOP if of == CLUSTER else frozenset({EBML, SEGMENT})
            while stop < end:
                child, inner = vint(b, stop, True)
                if child in ends:
                    break
                length, inner = vint(b, inner, False)
                if length < 0:
                    inner, length = next((s, e - s) for _, s, e in elements(b, stop, end))
                stop = inner + length
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element {of:x} ends at {stop}, its parent at {end}")
        yield of, at, stop
        at = stop


def _uint(b: bytes, start: int, end: int) -> int:
    return int.from_bytes(b[start:end], "big")


def _float(b: bytes, start: int, end: int) -> float:
    return struct.unpack(">f" if end - start == 4 else ">d", b[start:end])[0] if end > start else 0.0


def laced(b: bytes, at: int, end: int, kind: int) -> list[int]:
    """Sizes of a block's frames; at is behind the flags. The frames fill the end of the block."""
    n, at = b[at] + 1, at + 1
    if kind == 2:  # equal sizes
        if (end - at) % n:
            raise ValueError("frames of a fixed lace differ")
        return [(end - at) // n] * n
    sizes = []
    if kind == 1:  # Xiph: runs of 255
        for _ in range(n - 1):
            size = 0
            while b[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + b[at])
            at += 1
    else:  # EBML: the first size, then signed differences
        size, at = vint(b, at, False)
        sizes.append(size)
        for _ in range(n - 2):
            start = at
            delta, at = vint(b, at, False)
            if delta < 0:
                delta = (1 << 7 * (at - start)) - 1
            size += delta - ((1 << (7 * (at - start) - 1)) - 1)
            sizes.append(size)
        sizes = sizes[: n - 1]
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("lace sizes exceed the block")
    return [*sizes, last]


def parse(b: bytes) -> Parsed:
    """Tracks, packets in file order, and cues (timestamp in ns, track, cluster's byte position)."""
    tracks: dict[int, dict] = {}
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    scale, clusters = 1_000_000, 0

    def block(start: int, end: int, base: int, simple: bool, key: bool) -> None:
        track, at = vint(b, start, False)
        relative, flags = struct.unpack_from(">hB", b, at)
        at += 3
        kind = flags >> 1 & 3
        sizes = laced(b, at, end, kind) if kind else [end - at]
        at = end - sum(sizes)
        step = tracks.get(track, {}).get("default_duration", 0)
        for k, size in enumerate(sizes):
            packets.append(Packet(track, (base + relative) * scale + k * step, at, size, bool(flags & 0x80) if simple else key, clusters, k))
            at += size

    for of, start, end in elements(b, 0, len(b)):
        if of != SEGMENT:
            continue
        segment = start
        for top, start, end in elements(b, start, end):
            if top == INFO:
                for x, s, e in elements(b, start, end):
                    scale = _uint(b, s, e) if x == SCALE else scale
            elif top == TRACKS:
                for x, s, e in elements(b, start, end):
                    if x == TRACK:
                        t: dict = {}
                        for y, p, q in elements(b, s, e):
                            if y in (NUMBER, TYPE, DEFAULT_DURATION):
                                t[{NUMBER: "number", TYPE: "type", DEFAULT_DURATION: "default_duration"}[y]] = _uint(b, p, q)
                            elif y == CODEC:
                                t["codec"] = b[p:q].rstrip(b"\0").decode()
                            elif y == AUDIO:
                                for z, u, v in elements(b, p, q):
                                    if z == RATE:
                                        t["rate"] = _float(b, u, v)
                                    elif z in (CHANNELS, DEPTH):
                                        t["channels" if z == CHANNELS else "depth"] = _uint(b, u, v)
                        tracks[t["number"]] = t
            elif top == CLUSTER:
                base = 0
                for x, s, e in elements(b, start, end):
                    if x == TIMESTAMP:
                        base = _uint(b, s, e)
                    elif x == SIMPLE:
                        block(s, e, base, True, False)
                    elif x == GROUP:
                        inner = list(elements(b, s, e))
                        for y, p, q in inner:
                            if y == BLOCK:
                                block(p, q, base, False, all(z != REFERENCE for z, _, _ in inner))
                clusters += 1
            elif top == CUES:
                for x, s, e in elements(b, start, end):
                    if x == POINT:
                        time, where = 0, []
                        for y, p, q in elements(b, s, e):
                            if y == CUE_TIME:
                                time = _uint(b, p, q)
                            elif y == POSITIONS:
                                where.append({z: _uint(b, u, v) for z, u, v in elements(b, p, q)})
                        cues += [(time * scale, w.get(CUE_TRACK, 0), segment + w.get(CUE_CLUSTER, 0)) for w in where]
    return Parsed(tracks, packets, cues, scale)


def _size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(of: int, body: bytes | int) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    return of.to_bytes((of.bit_length() + 7) // 8, "big") + _size(len(body)) + body


_FRAME_NS = FRAME * 1_000_000_000 // HERTZ
_HEAD = element(EBML, element(VERSION, 1) + element(READ_VERSION, 1) + element(MAX_ID, 4) + element(MAX_SIZE, 8) + element(DOCTYPE, b"matroska") + element(DOC_VERSION, 4) + element(DOC_READ, 2))
_TRACKS = element(TRACKS, element(TRACK, element(NUMBER, 1) + element(UID, 1) + element(TYPE, 2) + element(LACING, 1) + element(DEFAULT_DURATION, _FRAME_NS) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">f", HERTZ)) + element(CHANNELS, 1) + element(DEPTH, 8))))


def write(payload: bytes) -> bytes:
    """A Matroska file with the bytes as 8-bit PCM: frames of FRAME bytes, LACE of them a block.

    Whole blocks use fixed lacing, a last block of whole frames and a rest EBML lacing.
    """
    duration = len(payload) * 1000 / HERTZ
    head = element(INFO, element(SCALE, 1_000_000) + element(MUXER, b"quirefold") + element(WRITER, b"quirefold") + element(DURATION, struct.pack(">d", duration))) + _TRACKS
    out, at, cues = [head], len(head), []
    step, span = FRAME * LACE, FRAME * LACE * CLUSTER_BLOCKS
    for first in range(0, len(payload), span):
        time = first * 1000 // HERTZ
        blocks = [element(TIMESTAMP, time)]
        for p in range(first, min(first + span, len(payload)), step):
            data = payload[p : p + step]
            n = -(-len(data) // FRAME)
            fixed = len(data) % FRAME == 0
            flags = 0x80 | (0 if n == 1 else 4 if fixed else 6)
            lace = b"" if n == 1 else bytes([n - 1]) + (b"" if fixed else _size(FRAME) + bytes([0xBF]) * (n - 2))
            blocks.append(element(SIMPLE, b"\x81" + struct.pack(">hB", p * 1000 // HERTZ - time, flags) + lace + data))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(POINT, element(CUE_TIME, time) + element(POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        out.append(cluster)
        at += len(cluster)
    if cues:
        out.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(out))


def feature(parsed: Parsed, payload: bytes) -> str:
    """Whole numbers only, so that equal payloads have equal features on any machine."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    side = x >= 0
    frames = len(parsed.packets)
    peak = int(np.abs(x).max()) if len(x) else 0
    crossings = int((side[1:] != side[:-1]).sum()) if len(x) else 0
    energy = int((x * x).sum(dtype=np.int64)) // max(1, len(x))
    hist = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8)
    last = max((p.timestamp_ns for p in parsed.packets), default=0) // 1_000_000
    return f"codec={parsed.tracks[1]['codec'] if 1 in parsed.tracks else ''};packets={frames};clusters={len(parsed.cues)};last_ms={last};peak={peak};energy={energy};crossings={crossings};hist={','.join(map(str, hist))}"


def padded(text: bytes, unit: int = FRAME) -> bytes:
    """Spaces up to a positive multiple of unit."""
    return text + b" " * (max(unit, -(-len(text) // unit) * unit) - len(text))


def read_back(media: bytes) -> tuple[Parsed, bytes]:
    p = parse(media)
    view = memoryview(media)
    return p, b"".join(view[x.offset : x.offset + x.size] for x in p.packets)


def encoded(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df with a binary column: each text's padded bytes as Matroska."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("binary")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([write(padded(x)) for x in utf8(pa.array(t, pa.string()))])

    return df.withColumn(media_col, run(F.col(text_col)))


def packets(df: DataFrame, id_col: str, media_col: str = "media", strict: bool = False) -> DataFrame:
    """The packet table of a media column: one row per frame; an unreadable file gives one row with an error."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "packet", "track", "timestamp_ns", "byte_offset", "byte_size", "key", "cluster", "lace", "error"]
    schema = f"id {kind}, packet bigint, track bigint, timestamp_ns bigint, byte_offset bigint, byte_size bigint, key boolean, cluster bigint, lace int, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for of, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(of, i, *p, None) for i, p in enumerate(parse(media or b"").packets)]
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    if strict:
                        raise
                    rows.append((of, *[None] * 8, str(e)))
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.string()]
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 50_000]], t) for k, t in enumerate(kinds)], names)

    return df.select(F.col(id_col), F.col(media_col)).mapInArrow(tidied(run), schema)


def summary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as media, reads the stored bytes back and describes both; one row per row.

    n_bytes is known from the text; all else comes from the stored form.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in utf8(b.column(1)):
                media = write(padded(text))
                parsed, payload = read_back(media)
                row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(parsed, payload))
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), schema)
