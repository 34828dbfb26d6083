"""Statistics of page images given as raw pixels (doc_id, page_number, width, height, pixels: RGB bytes)."""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _gray(p: np.ndarray) -> np.ndarray:
    return p @ np.array([0.299, 0.587, 0.114])


def is_blank(p: np.ndarray) -> bool:
    g = _gray(p)
    return bool(g.mean() >= 250 and g.std() < 1.5)


def cover_score(p: np.ndarray) -> float:
    """High for large, colourful, contrasting pages; measured on at most 256 by 256 samples."""
    step = max(1, -(-max(p.shape[:2]) // 256))
    q = p[::step, ::step].astype(float)
    if not q.size:
        return 0.0
    return 4 * float((q.mean(2) < 242).mean()) + 3 * float(np.ptp(q, axis=2).mean() / 255) + float(q.std(axis=(0, 1)).sum() / 384)


def background_box(p: np.ndarray) -> tuple[int, int, int, int] | None:
    """(left, top, right, bottom) of what differs from the corners' median colour; None for plain pages and specks."""
    q = p.astype(float)
    if not q.size or q.std(axis=(0, 1)).max() < 3:
        return None
    corners = np.median(np.stack([q[0, 0], q[0, -1], q[-1, 0], q[-1, -1]]), axis=0).round()
    seen = _gray(np.abs(q - corners)) > 12
    if not seen.any():
        return None
    rows, columns = np.flatnonzero(seen.any(1)), np.flatnonzero(seen.any(0))
    box = int(columns[0]), int(rows[0]), int(columns[-1]) + 1, int(rows[-1]) + 1
    return box if (box[2] - box[0]) * (box[3] - box[1]) >= 0.005 * p.shape[0] * p.shape[1] else None


def from_pnm(data: bytes) -> np.ndarray:
    """The RGB pixels of a binary PNM image, of one bit, of grays or of colours."""
    m = re.match(rb"P([456])((?:\s+#[^\n]*)*\s+)(\d+)((?:\s+#[^\n]*)*\s+)(\d+)", data)
    if not m:
        raise ValueError("not a binary PNM image")
    kind, wide, tall, at = m[1], int(m[3]), int(m[5]), m.end()
    most = 1
    if kind != b"4":
        n = re.match(rb"(?:\s+#[^\n]*)*\s+(\d+)", data[at:])
        if not n or not 0 < int(n[1]) < 256:
            raise ValueError("not an image of 8 bits")
        most, at = int(n[1]), at + n.end()
    raw = np.frombuffer(data, np.uint8, offset=at + 1)
    if kind == b"4":
        row = -(-wide // 8)
        bits = np.unpackbits(raw[: row * tall].reshape(tall, row), axis=1)[:, :wide]
        return np.repeat((255 * (1 - bits))[:, :, None], 3, axis=2).astype(np.uint8)
    deep = 3 if kind == b"6" else 1
    p = raw[: wide * tall * deep].reshape(tall, wide, deep)
    p = p if most == 255 else np.round(p * (255 / most)).astype(np.uint8)
    return np.repeat(p, 3, axis=2) if deep == 1 else p


def resized(p: np.ndarray, wide: int, tall: int) -> np.ndarray:
    """The image at another size; a pixel is the mean of those it covers."""
    for axis, n in ((0, tall), (1, wide)):
        edge = np.arange(n + 1) * p.shape[axis] // n
        start = np.minimum(edge[:-1], p.shape[axis] - 1)
        size = np.maximum(edge[1:] - edge[:-1], 1)
        total = np.add.reduceat(p.astype(float), start, axis=axis) if (edge[1:] > edge[:-1]).all() else np.take(p.astype(float), start, axis=axis)
        p = total / (size[:, None, None] if axis == 0 else size[None, :, None])
    return np.clip(np.round(p), 0, 255).astype(np.uint8)


def png(p: np.ndarray) -> bytes:
    """A PNG file: one bit a pixel where the image has two colours or fewer, else RGB."""
    flat = p.reshape(-1, 3).astype(np.uint32)
    few = len(np.unique(flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2])) <= 2
    rows = np.packbits(_gray(p) > 127, axis=1) if few else p.reshape(len(p), -1)
    raw = np.concatenate([np.zeros((len(p), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", p.shape[1], p.shape[0], 1 if few else 8, 0 if few else 2, 0, 0, 0)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def encoded(p: np.ndarray) -> tuple[bytes, str]:
    """(content, media type): PNG for two colours or fewer, else a progressive JPEG, or PNG where no library writes those."""
    flat = p.reshape(-1, 3).astype(np.uint32)
    if len(np.unique(flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2])) > 2:
        try:
            from PIL import Image
        except ImportError:
            return png(p), "image/png"
        out = io.BytesIO()
        Image.fromarray(p).save(out, format="JPEG", quality=85, optimize=True, progressive=True)
        return out.getvalue(), "image/jpeg"
    return png(p), "image/png"


def statistics(images: DataFrame) -> DataFrame:
    """(doc_id, page_number, blank, score, box) of page images."""
    kind = images.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                p = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
                out.append((r.doc_id, r.page_number, is_blank(p), cover_score(p), background_box(p)))
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "blank", "score", "box"])

    return images.select("doc_id", "page_number", "width", "height", "pixels").mapInPandas(run, f"doc_id {kind}, page_number int, blank boolean, score double, box array<int>")


def covers(scores: DataFrame, page: str = "page_number") -> DataFrame:
    """(doc_id, cover, score): the page with the highest score of each document; of equal scores the later one."""
    best = F.max(F.struct("score", F.col(page).alias("cover")))
    return scores.groupBy("doc_id").agg(best.alias("best")).select("doc_id", "best.cover", "best.score")
