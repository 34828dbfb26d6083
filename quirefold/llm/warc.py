"""WARC archives and their index: an external merge of locally sorted capture runs.

write(): every row becomes a record, gzipped on its own, in archives of bounded size (rows with a
binary column; Spark stores them wherever it writes tables). Of equal payloads of at least 1000
bytes the row with the largest id is a response, the others are revisits that refer to it.
read(): parses the archives; each one's captures, sorted by URL key and time, are a run.
merge(): runs are cut by splitters over the whole key (URL key, time, id), so that even one hot
URL spreads over many ranges; in each range a loser tree merges its k sorted run pieces. (range,
place) is the global order of the capture histories, and capture_no counts it.

Cases: null payloads count as empty; null urls are stored as about:blank; null ids give an empty
id and never refer; rows that repeat an id and its payload are both responses if the id is the
group's largest; an empty table gives no archive; other columns are ignored; control characters
and spaces in urls are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.llm import common
from quirefold.llm.common import bounded_batches, join_facts, keep, tidied
from quirefold.llm.exact_dedup import filter_bits, hit, may_be_in

LEAST = 1000
ARCHIVE_BYTES = 8 << 20
ROWS_A_RANGE = 200_000
# Fixed value: the profile of records that repeat a payload, from WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:quirefold:page:{}>"
_EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)
ENTRY = ["id", "urlkey", "captured", "record_type", "refers_to", "payload_bytes", "payload_digest", "archive", "at", "length"]


def url_key(url: str) -> str:
    """The host's labels reversed, then path and query: captures of a site and a page sort together."""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url
    if not host:
        return url
    port = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{port}){u.path or '/'}{'?' + u.query if u.query else ''}"


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "about:blank"


def record(page: Any, url: str, when: str, payload: bytes, refers_to: Any, size: int, sha1: bytes) -> bytes:
    """One gzipped record; a revisit (refers_to is not None) has the response's HTTP head and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_ID.format('' if page is None else page)}", f"WARC-Date: {when}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_ID.format(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def members(data: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, content) of the gzip members of an archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, start, out = zlib.decompressobj(31), at, []
        while not z.eof:
            if at >= len(data):
                raise ValueError(f"record at {start} is cut off")
            out.append(z.decompress(view[at : at + step]))
            at = min(at + step, len(data))
        at -= len(z.unused_data)
        yield start, at - start, b"".join(out)


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a record, in lower case, and its block."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _page(field: str | None, whole: bool) -> Any:
    text = (field or "")[len(_ID.format("")) - 1 : -1]
    return None if not text else int(text) if whole else text


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None) -> DataFrame:
    """(archive, data): archives of about ARCHIVE_BYTES.

    What is repeated is worked out on (id, digest) alone. While the revisits are few they are
    broadcast and no payload moves; beyond, payloads whose digest a filter of the revisits' misses
    stay where they are, and the others meet what they refer to by digest and id, so that no
    digest, however often it stands, is one task's.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    when = F.col(time_col).cast("timestamp") if time_col else F.lit(None).cast("timestamp")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body"), when.alias("captured")).withColumn("sha", F.unhex(F.sha1("body")))
    large = keep(rows.filter(F.octet_length("body") >= LEAST).select("id", "sha"))
    last = keep(large.groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null"))
    revisits = join_facts(large, last, "sha", "n", large.count()).filter(~F.col("id").eqNullSafe(F.col("last")))
    revisits = keep(revisits.select(F.col("sha").alias("s"), F.col("id").alias("i"), "last").distinct())
    few, met = revisits.count(), (F.col("sha") == F.col("s")) & F.col("id").eqNullSafe(F.col("i"))
    if few <= common.BROADCAST_IDS:
        rows = rows.join(F.broadcast(revisits), met, "left")
    else:
        bits = filter_bits(few)
        first = F.udf(lambda s: int.from_bytes(s[:8], "little", signed=True), "bigint", useArrow=True)
        maybe = may_be_in(spark, hit(revisits.select(first("s").alias("h")), bits, least=1), bits)
        rows = rows.withColumn("maybe", maybe(first("sha")))
        rows = rows.filter("maybe").join(revisits, met, "left").drop("s", "i").unionByName(rows.filter("not maybe").withColumn("last", F.lit(None).cast(pages.schema[id_col].dataType)))
    rows = rows.select("id", "url", F.unix_micros("captured").alias("captured"), "body", "sha", F.col("last").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, buffer, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:08d}-{number:06d}"]), pa.array([b"".join(buffer)], pa.binary())], ["archive", "data"])

        for b in batches:
            for page, url, captured, payload, sha, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if captured is not None:
                    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=captured)
                else:  # without a time, ids count seconds
                    at = _EPOCH + timedelta(seconds=page % (1 << 31) if isinstance(page, int) else 0)
                buffer.append(record(page, _safe(url or ""), f"{at:%Y-%m-%dT%H:%M:%SZ}", payload, refers, len(payload), sha))
                size += len(buffer[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    number, buffer, size = number + 1, [], 0
        if buffer:
            yield flush()

    return rows.mapInArrow(tidied(run), "archive string, data binary")


def _kinds(whole: bool) -> list:
    of = pa.int64() if whole else pa.string()
    return [of, pa.string(), pa.string(), pa.string(), of, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _schema(whole: bool) -> str:
    of = "bigint" if whole else "string"
    return f"id {of}, urlkey string, captured string, record_type string, refers_to {of}, payload_bytes bigint, payload_digest string, archive string, at bigint, length bigint"


def entries_of(archive: str, data: bytes, whole: bool) -> list[tuple]:
    """One run: the archive's captures in order of (URL key, time, id). Digests of payloads are recomputed."""
    run = []
    for start, length, content in members(data):
        fields, block = parsed(content)
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
        if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{archive}: the record at {start} is damaged")
        run.append((_page(fields["warc-record-id"], whole), url_key(fields["warc-target-uri"]), re.sub(r"\D", "", fields["warc-date"]), fields["warc-type"], _page(fields.get("warc-refers-to"), whole), size, digest, archive, start, length))
    return sorted(run, key=order)


def order(e: tuple) -> tuple:
    return (e[1], e[2], e[0] is not None, e[0] if e[0] is not None else 0)


def read(archives: DataFrame, whole_ids: bool = True) -> DataFrame:
    """The captures of the archives with (run, step): each archive is a run, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = entries_of(archive, data, whole_ids)
                for i in range(0, len(rows), 20_000):
                    part = rows[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in part], t) for k, t in enumerate(_kinds(whole_ids))], pa.array(range(i, i + len(part)), pa.int64())], [*ENTRY, "step"])

    return archives.select("archive", "data").mapInArrow(tidied(run), _schema(whole_ids) + ", step bigint")


class LoserTree:
    """Merges k sorted sequences; each next() replays one path of comparisons from a leaf to the root."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [self._pull(i) for i in range(self.k)]
        self.losers = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._seat(leaf)

    def _pull(self, i: int):
        x = next(self.runs[i], None)
        return None if x is None else (self.key(x), i, x)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x[:2] < y[:2]

    def _seat(self, winner: int) -> None:
        """Plays a leaf up to the first empty seat, or to the root, seat 0."""
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[w := self.losers[0]]) is not None:
            yield head[2]
            self.heads[w] = self._pull(w)
            node = (w + self.k) // 2
            while node > 0:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.losers[0] = w


def merge(runs: DataFrame, whole_ids: bool = True, ranges: int | None = None) -> DataFrame:
    """All captures with (range, place), the global order. Splitters come from 20 sampled keys a range."""
    spark, n = runs.sparkSession, runs.count()
    r = ranges or max(min(256, -(-n // 4000)), -(-n // ROWS_A_RANGE), 1)
    some = runs.select("id", "urlkey", "captured").sample(min(1.0, 20 * r / max(n, 1)), seed=5) if n > 20 * r else runs.select("id", "urlkey", "captured")
    keys = sorted(order((x.id, x.urlkey, x.captured)) for x in some.toLocalIterator())
    cuts = spark.sparkContext.broadcast([keys[i * len(keys) // r] for i in range(1, r)] if keys else [])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, times = (b.column(i).to_pylist() for i in range(3))
            at = [bisect_right(cuts.value, order((i, u, t))) for i, u, t in zip(ids, urls, times, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], [*b.schema.names, "range"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs_here, last = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for place, e in enumerate(LoserTree([iter(x) for x in runs_here], order)):
                rows.append((*e, now, place))
                if len(rows) == 20_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate([*_kinds(whole_ids), pa.int64(), pa.int64()])], [*ENTRY, "range", "place"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[-1] != now:
                    if runs_here:
                        yield from out()
                    now, runs_here, last = row[-1], [], None
                if row[7] != last:
                    runs_here.append([])
                    last = row[7]
                runs_here[-1].append(row[:-2])
        if runs_here:
            yield from out()

    dealt = runs.mapInArrow(deal, _schema(whole_ids) + ", step bigint, range bigint").repartition(r, "range").sortWithinPartitions("range", "archive", "step")
    return dealt.mapInArrow(pieces, _schema(whole_ids) + ", range bigint, place bigint")


def histories(pages: DataFrame, **columns) -> DataFrame:
    """Archives written, read back and merged into one ordered index; capture_no is a capture's place in it, from 1 on."""
    whole = pages.schema[columns.get("id_col", "page_id")].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    archives = keep(write(pages, **columns), "uncompressed")
    merged = keep(merge(keep(read(archives, whole)), whole))
    # one row a range: few, whatever the size of a range
    before = merged.groupBy("range").agg(F.count("*").alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return merged.join(F.broadcast(before), "range").withColumn("capture_no", F.col("before") + F.col("place") + 1).drop("before")
