"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document is the set of its distinct k-word shingles. Documents with equal sets form a class,
and only classes' representatives (the smallest id) go on. Fast similarity sketching throws all
shingles at t bins in rounds: round i < t hashes each shingle to a random bin with the value
i + fraction, round t + j throws all of them at bin j, so that after 2 t rounds no bin can be
empty; a bin keeps its smallest value, and rounds end once all are filled (after one or two for
most texts). Bins agree with the probability of the Jaccard similarity and are concentrated like
independent ones. Bands of the sketch propose links.

A band's bucket is never expanded into pairs. Its members are linked to one hub, the bucket's
smallest id: first each document with the hub it shares most bands with, then what is still in
different components. In buckets whose members are even then in different components, all members
outside the bucket's largest component are queries against the bucket, in blocks of bounded bytes.
A block looks its queries' rarest shingles up in an inverted index of its members (two sets that
are similar share one of them), confirms on the full sets and puts out one link for every two
components that it joins: fewer rows than it read, however large the group. Every link is
confirmed on the full sets, and no link between proposed documents is lost.

With 36 bands of 5 bins, a pair at similarity 0.8 shares no band with a probability below 1e-6.

Cases: null and wordless texts have an empty set, are linked with nothing and stay; texts with
fewer words than k are one shingle, the whole sequence; rows that repeat an id form one document
if their sets agree, else documents of their own under that id, of which dedup() removes rows by
id and text; null ids are documents of no class; an empty table gives an empty result; other
columns pass through dedup().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import WordHashes, bounded_batches, chunks, components, ids_hint, join_facts, keep, mix, runs_of, shingles, tidied, utf8

ROWS, BANDS = 5, 36
PAIRS_A_PART = 500
#: What a block holds of a bucket, of its queries as of its members: a quarter of it, between so many rows, and so many bytes at most; one document may be larger.
PART_ROWS, MOST_ROWS, PART_BYTES = 500, 4000, 8 << 20


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t bins per set; sets must not be empty. A bin holds (round << 32 | fraction)."""
    count = np.array([len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), count)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = np.full(len(sets) * t, none)
    for i in range(2 * t):
        h = mix(items ^ mix(np.array([i + 1], np.uint64))[0])
        at = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(bins, owner * t + at, np.uint64(i) << np.uint64(32) | h & np.uint64(0xFFFFFFFF))
        open_ = (bins.reshape(-1, t) == none).any(axis=1)
        if not open_.any():
            break
        if not open_[owner].all():
            still = open_[owner]
            items, owner = items[still], owner[still]
    return bins.reshape(-1, t)


def bands(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    k = sketch.reshape(len(sketch), -1, ROWS)
    out = np.broadcast_to(mix(np.arange(1, k.shape[1] + 1, dtype=np.uint64)), k.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out ^ mix(k[:, :, i]))
    return out


def shingle_sets(texts: list[bytes], k: int, seen: WordHashes) -> list[np.ndarray]:
    return [shingles(seen.of(x.lower().split()), k) for x in texts]


def sketched(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n, same, bands): a hash of the text, the set's size, 128 bits that equal sets share, and band keys."""
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for b in batches:
            for at, texts in chunks(utf8(b.column(1)), 2 << 20):
                sets = shingle_sets(texts, k, seen)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = bands(sketches([sets[i] for i in full], ROWS * BANDS)).astype("<u8").view("<i8") if full else np.zeros((0, BANDS), "<i8")
                same: list[bytes | None] = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                lists: list = [None] * len(sets)
                for i, row in zip(full, keys, strict=True):
                    lists[i] = row
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(2).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["id", "key", "n", "same", "bands"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key")).mapInArrow(tidied(run), f"id {kind}, key bigint, n bigint, same binary, bands array<bigint>")


def full_sets(df: DataFrame, k: int, id_col: str, text_col: str, names: DataFrame) -> DataFrame:
    """(id, items): the sorted shingle hashes of the representatives in names (node, rep, same), which go by their nodes."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for b in batches:
            for at, texts in chunks(utf8(b.column(1)), 2 << 20):
                items = [s.astype("<u8").tobytes() for s in shingle_sets(texts, k, seen)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array([xxhash.xxh3_128_digest(x) for x in items], pa.binary()), pa.array(items, pa.binary())], ["rep", "same", "items"])

    few = names.count()
    rows = df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(ids_hint(names.select("rep").distinct(), few), "rep", "left_semi")
    sets = rows.mapInArrow(tidied(run), f"rep {kind}, same binary, items binary").dropDuplicates(["rep", "same"])
    return keep(sets.join(ids_hint(names, few), ["rep", "same"]).select(F.col("node").alias("id"), "items"), "uncompressed")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough: 100 * intersection >= percent * union."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # a hub's pairs meet copies of its set in parts, so that no hub is one task's
    pairs = keep(pairs)
    many = keep(pairs.groupBy("a").agg(F.expr(f"cast(count(*) div {PAIRS_A_PART} + 1 as int)").alias("parts")).filter("parts > 1"))
    split = lambda rows: rows.join(ids_hint(many, few), "a", "left").fillna({"parts": 1})
    few = many.count()
    left = split(sets.select(F.col("id").alias("a"), F.col("items").alias("x"))).select("a", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    pairs = split(pairs).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    return keep(pairs.join(left, ["a", "part"]).join(right, "b").select("a", "b", "x", "y").mapInArrow(tidied(run), f"a {kind}, b {kind}"))


def groups(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n (the set's size), root (smallest id that links lead to)."""
    return _grouped(df, k, percent, id_col, text_col).select("id", "n", "root")


def _grouped(df: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """groups() with key (a hash of the text) and gone: whether another document stands for the row."""
    s = keep(sketched(df, k, id_col, text_col), "zstd")
    full = s.filter("same is not null")
    total = s.count()
    facts = keep(full.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("rows")))
    # an id may stand for several classes, so that links go by a number of the class, in the order of ids
    facts = keep(facts.orderBy("rep", "same").withColumn("node", F.monotonically_increasing_id()))
    members = keep(join_facts(full.select("id", "key", "n", "same"), facts, "same", "rows", total).select("id", "key", "n", "rep", "node"))
    names = facts.filter("rep is not null").select("rep", "same", "node")
    reps = full.withColumnRenamed("id", "rep").join(names, ["rep", "same"]).dropDuplicates(["node"]).select(F.col("node").alias("id"), "n", "bands")
    keyed = keep(reps.select("id", "n", F.explode("bands").alias("band")), "zstd")
    buckets = keep(keyed.groupBy("band").agg(F.min("id").alias("hub"), F.min_by("n", "id").alias("hub_n"), F.count("*").alias("size")).filter("size > 1"))
    inside = keep(join_facts(keyed, buckets, "band", "size", keyed.count()).select("band", "hub", "hub_n", "size", "id", "n"), "zstd")
    close = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    star = keep(inside.filter("id <> hub").filter(close).groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared")))
    wide = inside.filter("size > 2")
    ids = keep(star.select(F.col("a").alias("id")).union(star.select("b")).union(wide.select("id")).distinct())
    sets = full_sets(df, k, id_col, text_col, keep(names.join(ids.withColumnRenamed("id", "node"), "node", "left_semi")))

    # each document with the hub that it shares most bands with, then what is still apart
    best = star.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    links = confirmed(best.select("a", "b"), sets, percent)
    roots = components(links)
    apart = star.select("a", "b").join(best, ["a", "b"], "left_anti")
    links = keep(links.union(confirmed(_different(apart, roots), sets, percent)))
    roots = components(links)

    # buckets of three or more whose members are in different components
    labelled = keep(_rooted(wide.select("band", "id", "n"), roots, "id", "root"), "zstd")
    parts = labelled.groupBy("band", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("items"))
    largest = F.struct("rows", "items", -F.col("root"))
    mixed = parts.groupBy("band").agg(F.max_by("root", largest).alias("main"), F.sum("rows").alias("rows"), F.sum("items").alias("items"), F.max(largest).alias("of_main"), F.count("*").alias("roots"))
    cut = lambda rows, items: F.greatest(F.ceil(rows / F.greatest(F.lit(PART_ROWS), F.least(F.lit(MOST_ROWS), rows / 4))), F.ceil(items * 8 / PART_BYTES), F.lit(1)).cast("int")
    mixed = keep(mixed.filter("roots > 1").select("band", "main", "rows", cut(F.col("rows"), F.col("items")).alias("parts"), cut(F.col("rows") - F.col("of_main.rows"), F.col("items") - F.col("of_main.items")).alias("asking")))
    links = keep(links.union(_across(join_facts(labelled, mixed, "band", "rows", labelled.count()), sets, percent)))
    roots = components(links)

    linked = roots.join(names.select(F.col("node").alias("root"), F.col("rep").alias("first")), "root").select(F.col("id").alias("node"), "first")
    rooted = members.join(linked, "node", "left").select("id", "key", "n", F.coalesce("first", "rep").alias("root"), (F.col("first").isNotNull() | (F.col("id") != F.col("rep"))).alias("gone"))
    return rooted.unionByName(s.filter("same is null").select("id", "key", "n", F.col("id").alias("root"), F.lit(False).alias("gone")))


def _across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components that meet in a band.

    rows (band, id, root, main, parts, asking): those outside the component main are queries. The
    band is cut into that many parts, its queries into as many as asking says; each block holds
    some queries against some members.
    """
    kind = rows.schema["id"].dataType.simpleString()
    d = rows.withColumn("apart", F.col("root") != F.col("main")).join(sets, "id")
    number = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asked = d.filter("apart").withColumn("i", number("asking")).withColumn("j", every("parts")).withColumn("asks", F.lit(True))
    there = d.withColumn("i", every("asking")).withColumn("j", number("parts")).withColumn("asks", F.lit(False))
    both = asked.unionByName(there).select("band", "i", "j", "asks", "apart", "id", "root", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ["band", "i", "j"]):
            a, b = block_links(*(t.column(c).to_numpy() for c in ("asks", "apart", "id", "root")), [np.frombuffer(x.as_py(), "<u8") for x in t.column("items")], percent)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, t.schema.field("id").type), pa.array(b, t.schema.field("id").type)], ["a", "b"])

    ordered = both.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return ordered.mapInArrow(tidied(run), f"a {kind}, b {kind}")


def block_links(asks: np.ndarray, apart: np.ndarray, ids: np.ndarray, root: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list, list]:
    """Links that join the components of a block: each query (asks) against the members, until their components are one.

    A set similar to one of n shingles shares percent of them, hence at least one of any
    n - ceil(percent * n / 100) + 1; those with the fewest members are looked up. What they hit
    bounds the intersection, and only members that the bound lets through are counted in full.
    """
    names, comp = np.unique(root, return_inverse=True)
    over = list(range(len(names)))

    def top(c: int) -> int:
        while over[c] != c:
            over[c] = c = over[over[c]]
        return c

    member, first, second = np.flatnonzero(~asks), [], []
    size = np.array([len(s) for s in sets])
    items = np.concatenate([sets[m] for m in member])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], np.repeat(np.arange(len(member)), size[member])[order]

    def hits(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How often each member stands in the index's ranges."""
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=len(member))

    for q in np.flatnonzero(asks):
        lo = np.searchsorted(items, sets[q], "left")
        n = np.searchsorted(items, sets[q], "right") - lo
        rare = np.argsort(n, kind="stable")
        some, rest = np.split(rare, [size[q] - -(-percent * size[q] // 100) + 1])
        got = hits(lo[some], n[some])
        # of two that are apart, the pair belongs to the smaller id
        open_ = (got > 0) & (root[member] != root[q]) & (~apart[member] | (ids[member] > ids[q]))
        least = percent * (size[member] + size[q])  # of the intersection, times 100 + percent
        found = np.flatnonzero(open_ & ((100 + percent) * (got + len(rest)) >= least) & (100 * np.minimum(size[member], size[q]) >= percent * np.maximum(size[member], size[q])))
        if not len(found) or all(top(comp[member[f]]) == top(comp[q]) for f in found):
            continue
        got = got + hits(lo[rest], n[rest])
        for f in found[(100 + percent) * got[found] >= least[found]]:
            x, y = top(comp[member[f]]), top(comp[q])
            if x != y:
                over[x] = y
                first.append(min(ids[q], ids[member[f]]))
                second.append(max(ids[q], ids[member[f]]))
    return first, second


def _rooted(rows: DataFrame, roots: DataFrame, by: str, out: str) -> DataFrame:
    """rows with the root of the id in column by; ids without a link are their own."""
    r = roots.select(F.col("id").alias("__by"), F.col("root").alias("__root"))
    return rows.join(r, F.col(by) == F.col("__by"), "left").withColumn(out, F.coalesce("__root", F.col(by))).drop("__by", "__root")


def _different(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    return _rooted(_rooted(pairs, roots, "a", "ra"), roots, "b", "rb").filter("ra <> rb").select("a", "b")


def dedup(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each group the document with the smallest id."""
    g = _grouped(df, k, percent, id_col, text_col)
    gone = keep(g.filter("gone and id is not null").select(F.col("id").alias("__qf_id"), F.col("key").alias("__qf_key")).distinct())
    return df.join(ids_hint(gone, gone.count()), (F.col(id_col) == F.col("__qf_id")) & (F.xxhash64(text_col) == F.col("__qf_key")), "left_anti")
