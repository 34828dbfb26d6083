"""What several operators share: scratch tables, word splitting, hashing, skew-proof joins, links to components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: A word, for Java's and DuckDB's regular expressions; bytes.split() cuts the same words out of UTF-8.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot when it holds more than one row in so many; there can't be more hot keys than that.
HOT_ONE_IN = 200
#: Rows of a table of ids (at most 16 bytes each) that may be broadcast; beyond, the join shuffles.
BROADCAST_IDS = 500_000
#: Bytes of text that one call into Python gets at a time.
BATCH_BYTES = 4 << 20

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded in bytes too, so that very long texts can't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_SCRATCH: dict[int, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's own folder below spark.checkpoint.dir; without one, a temporary folder in local mode, an error on a cluster."""
    app = id(spark.sparkContext)
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='quirefold-')}"
        _SCRATCH[app] = f"{base.rstrip('/')}/quirefold-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended already; the folder's owner cleans up
        return


def keep(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes the rows to the shared folder and reads them again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def orderable(kind: DataType) -> bool:
    """Whether values of the type have an order."""
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return orderable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def ids_hint(df: DataFrame, rows: int) -> DataFrame:
    """A table of ids is broadcast only when its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of rows with one fact a key. Hot keys (fewer than HOT_ONE_IN by definition) are
    broadcast, so that their rows stay where they are; the others meet by a shuffle."""
    hot = facts.filter(F.col(count) * HOT_ONE_IN > total)
    cold = facts.filter(F.col(count) * HOT_ONE_IN <= total)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


def remainder(col, by: int):
    """crc32 of the id as text, modulo by; a null id counts as an empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % F.lit(by)


def utf8(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """Texts as UTF-8, null as empty, without a detour over str."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist():
        yield x or b""


def tidy() -> None:
    """Gives memory back: workers live on when a task has ended, and serve other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only the GNU library has it
        trim(0)


def tidied(run):
    """run, a function from batches to batches, that tidies up when its task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words of late."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; of fewer words the whole sequence is one; of none, none."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - k + 1)
    out = np.full(n, len(hashes) if len(hashes) < k else k, np.uint64)
    for i in range(min(k, len(hashes))):
        out = mix(out ^ mix(hashes[i : i + n]) if i else out ^ hashes[:n])
    return np.unique(out)


def chunks(texts: Iterable[bytes], most: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about so many bytes, each with the index of its first."""
    at, run, size = 0, [], 0
    for i, x in enumerate(texts):
        run.append(x)
        size += len(x)
        if size >= most:
            yield at, run
            at, run, size = i + 1, [], 0
    if run:
        yield at, run


def runs_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches cut into one table per run of equal keys (integers)."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            now = tuple(k[:, s])
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(id, root) of every id that has an edge: root is the smallest id that edges lead to.

    Alternates large-star and small-star steps, each a minimum by key (combined before the
    shuffle) and an equi-join, until a step changes nothing; it is an error if that takes more than
    rounds, if given. Nothing goes to the driver but counts.
    """
    e = keep(edges.select(F.least(a, b).alias("p"), F.greatest(a, b).alias("c")).filter("p < c").distinct())
    last = None
    for done in count():
        if done == rounds:
            raise RuntimeError(f"components are not stable after {rounds} rounds")
        # large star: all larger neighbours move to the smallest of the neighbourhood
        both = e.select(F.col("p").alias("x"), F.col("c").alias("y")).unionByName(e.select(F.col("c").alias("x"), F.col("p").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        e = both.join(low, "x").filter("y > x").select(F.col("m").alias("p"), F.col("y").alias("c")).filter("p < c").distinct()
        # small star: smaller neighbours and the id itself move to the smallest of them
        low = e.groupBy("c").agg(F.min("p").alias("m"))
        e = e.join(low, "c")
        e = keep(e.select(F.col("m").alias("p"), F.col("p").alias("c")).unionByName(e.select(F.col("m").alias("p"), "c")).filter("p < c").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("p", "c").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
    return e.select(F.col("c").alias("id"), F.col("p").alias("root"))
