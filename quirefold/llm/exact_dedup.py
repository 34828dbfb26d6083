"""Exact dedup by two passes over a Bloom filter.

Pass 1 adds the hash of every text to a counting filter that knows "once" and "twice"; pass 2
keeps back only rows whose positions were all hit twice. Only those rows shuffle, as (hash, id);
all others are unique for certain and pass straight through.

The filter has 16 bits a row. What is broadcast at a time has MOST_BITS at most (32 MB, the proven
bound); beyond, hashes are cut by their highest bits into ranges, each with its own filter and its
own scan of the table of hashes, up to MOST_RANGES (half a billion rows). Only beyond that do
filters get denser, so that more (hash, id) rows shuffle; results stay exact. A filter is built
without a driver-side merge: each task emits sparse positions by slice of 2^16 bits, and a group
per slice merges them.

dedup() needs to know of repeated texts only. While those are few, what is known of them is
broadcast; beyond, their digests go into such a filter too, and rows that miss it stay where they
are.

Cases: null text counts as empty; empty texts equal each other; rows that repeat an id and its
text are one document twice, of which exactly one stays, the first by the columns that have an
order; a null id is smaller than any other; an empty table gives an empty result; other columns,
whatever their names and types, are passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import BROADCAST_IDS, bounded_batches, column, ids_hint, join_facts, keep, orderable, utf8

MOST_BITS = 1 << 28
MOST_RANGES = 32
SLICE = 16  # a slice has 2^16 bits


def sha256_normalised(text: pa.Array) -> list[bytes]:
    """Digests of the texts with A-Z lower-cased and nothing else changed."""
    return [hashlib.sha256(x.lower()).digest() for x in utf8(text)]


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, h, row): 256-bit digest of the normalised text, 64 bits of it, and a number of the row."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = sha256_normalised(b.column(1))
            h = np.frombuffer(b"".join(x[:8] for x in sha), "<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.binary()), pa.array(h)], ["id", "sha", "h"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(run, f"id {kind}, sha binary, h bigint")
    return keep(out.withColumn("row", F.monotonically_increasing_id()))


def filter_bits(rows: int) -> int:
    return min(MOST_BITS, 1 << max(SLICE, (16 * rows - 1).bit_length()))


def ranges(rows: int) -> int:
    """Into how many ranges of hashes, a power of two, so many rows are cut."""
    return min(MOST_RANGES, 1 << max(0, -(-16 * rows // MOST_BITS) - 1).bit_length())


def in_range(h, number: int, of: int):
    """Whether a hash is in a range by its highest bits, which positions in a filter don't use."""
    return F.shiftrightunsigned(h, 64 - (of.bit_length() - 1)) == number if of > 1 else F.lit(True)


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Two positions of each hash, one row each: of its lowest bits, and of those from the 28th on."""
    u = h.astype(np.uint64)
    return np.stack([u & np.uint64(bits - 1), (u >> np.uint64(28)) & np.uint64(bits - 1)])


def hit(hashes: DataFrame, bits: int, least: int = 2) -> np.ndarray:
    """Pass 1: the bitmap of positions that at least so many rows (one or two) hit."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = positions(b.column(0).to_numpy(zero_copy_only=False), bits)
            p[1, p[0] == p[1]] = p[0, p[0] == p[1]]
            at, n = np.unique(np.concatenate([p[0], p[1][p[0] != p[1]]]), return_counts=True)
            part = (at >> np.uint64(SLICE)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            low = (at & np.uint64((1 << SLICE) - 1)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[cuts]),
                    pa.array([low[i:j].tobytes() for i, j in zip(cuts, [*cuts[1:], len(at)], strict=True)], pa.binary()),
                    pa.array([low[i:j][n[i:j] > 1].tobytes() for i, j in zip(cuts, [*cuts[1:], len(at)], strict=True)], pa.binary()),
                ],
                ["part", "once", "twice"],
            )

    def merge(t: pa.Table) -> pa.Table:
        n = np.zeros(1 << SLICE, np.int64)
        for name in ("once", "twice"):
            for x in t.column(name).to_pylist():
                n[np.frombuffer(x, "<u2")] += 1
        return pa.table({"part": t.column("part").slice(0, 1), "bits": pa.array([np.packbits(n >= least, bitorder="little").tobytes()], pa.binary())})

    sparse = hashes.select("h").mapInArrow(local, "part bigint, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in sparse.groupBy("part").applyInArrow(merge, "part bigint, bits binary").toLocalIterator():
        out[r.part << (SLICE - 3) : (r.part + 1) << (SLICE - 3)] = np.frombuffer(r.bits, np.uint8)
    return out


def found(h: np.ndarray, filled: np.ndarray, bits: int) -> np.ndarray:
    """Whether both positions of each hash are hit."""
    p = positions(h, bits)
    return ((filled[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def may_be_in(spark: SparkSession, filled: np.ndarray, bits: int):
    """Pass 2: a column function of h that is false only where the filter was certainly not hit."""
    shared = spark.sparkContext.broadcast(filled)
    return F.pandas_udf(lambda h: pd.Series(found(h.to_numpy(), shared.value, bits)), "boolean")


def flagged(d: DataFrame, total: int) -> DataFrame:
    """d (h, ...) with maybe: false where the row's hash stands once for certain. A range of hashes at a time."""
    bits, of = filter_bits(total), ranges(total)
    out = None
    for number in range(of):
        part = d.filter(in_range(F.col("h"), number, of)) if of > 1 else d
        part = part.withColumn("maybe", may_be_in(d.sparkSession, hit(part, bits), bits)("h"))
        out = part if out is None else out.unionByName(part)
    return out


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, sha, keep_id (largest id of equal texts), group_size, kept."""
    d = digests(df, id_col, text_col)
    total = d.count()
    d = flagged(d, total)
    single = d.filter(~F.col("maybe")).select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    some = keep(d.filter("maybe").drop("maybe", "h"))
    facts = some.groupBy("sha").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("last"))
    shared = join_facts(some, keep(facts), "sha", "group_size", total)
    return single.unionByName(shared.select("id", "sha", F.col("last.id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept")))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the row with the largest id.

    Rows of texts that stand once keep their place; the others meet what is known of their digest
    and id by a join on both, which no hot digest can skew.
    """
    spark, d = df.sparkSession, digests(df, id_col, text_col)
    total = d.count()
    some = keep(flagged(d, total).filter("maybe").select("id", "sha", "h"))
    facts = keep(some.groupBy("sha").agg(F.count("*").alias("n"), F.max("id").alias("last")).filter("n > 1"))
    # what is decided for every digest and id that stands on rows with a repeated text
    each = join_facts(some.select("sha", "h", "id"), facts, "sha", "n", total)
    each = keep(each.groupBy("sha", "id").agg(F.first("h").alias("h"), F.count("*").alias("rows"), F.first("last").alias("last")))
    each = each.withColumn("stays", F.col("id").eqNullSafe(F.col("last")))
    few = each.count()
    bits = filter_bits(few)
    repeated = spark.sparkContext.broadcast(hit(each, bits, least=1))

    @F.pandas_udf("sha binary, maybe boolean")
    def tag(text: pd.Series) -> pd.DataFrame:
        sha = sha256_normalised(pa.array(text, pa.string()))
        return pd.DataFrame({"sha": sha, "maybe": found(np.frombuffer(b"".join(x[:8] for x in sha), "<i8"), repeated.value, bits)})

    names = [f"__qf_{i}" for i in range(len(df.columns))]
    key, text = names[df.columns.index(id_col)], names[df.columns.index(text_col)]
    rows = df.toDF(*names).withColumn("__qf", tag(F.col(text))).select(*names, F.col("__qf.sha").alias("__qf_sha"), F.col("__qf.maybe").alias("__qf_maybe"))
    told = ids_hint(each.select(F.col("sha").alias("__qf_s"), F.col("id").alias("__qf_i"), F.col("stays").alias("__qf_stays"), F.col("rows").alias("__qf_rows")), few)
    met = rows if few <= BROADCAST_IDS else rows.filter("__qf_maybe")
    met = met.join(told, (F.col("__qf_sha") == F.col("__qf_s")) & F.col(key).eqNullSafe(F.col("__qf_i")), "left").filter("coalesce(__qf_stays, true)")
    out = met.filter("coalesce(__qf_rows, 1) = 1").select(*names)
    if few > BROADCAST_IDS:
        out = out.union(rows.filter("not __qf_maybe").select(*names))
    if not each.filter("stays and rows > 1").isEmpty():
        order = F.struct(*[n for n, f in zip(names, df.schema.fields, strict=True) if orderable(f.dataType)], "__qf_row")
        one = met.filter("__qf_rows > 1").withColumn("__qf_row", F.monotonically_increasing_id()).groupBy("__qf_sha", key).agg(F.min_by(F.struct(*names), order).alias("__qf_row"))
        out = out.union(one.select(*[F.col(f"__qf_row.{n}").alias(n) for n in names]))
    return out.toDF(*df.columns)
