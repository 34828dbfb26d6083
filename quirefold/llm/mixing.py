"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size (words). Shares of the total are given out in proportion to
the weights; a source whose share exceeds max_epochs times its size is clamped there, and what it
can't take is dealt again among the others, until no share is too large. A source then takes
floor(share / size) whole repetitions of all its documents and, for the fraction that is left, the
documents that come first in a seeded order, up to the point where the next document would take
the sum further from the share than it is.

The seeded order is that of md5(seed:id). Each source is cut into 65,536 buckets of that order, so
that the prefix sums of a hot source spread over as many groups; what stands before a bucket adds
up in two steps of 256 sums.

Cases: null texts and texts without words have size 0 and are taken whole times only; null is a
source of its own; a source without words has the target 0; repeated rows are documents of their
own; ties in the order go to the smaller document; an empty table gives an empty result; other
columns, whatever their names, are passed through mix() and never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.llm.common import WORD, column, ids_hint, keep


def words(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """place: 0-based rank of the source by code point, null last; without a window over all sources."""
    s = keep(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("m", F.monotonically_increasing_id()))
    s = s.withColumn("part", F.shiftright("m", 33))
    before = s.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    return s.join(F.broadcast(before), "part").select(*sources.columns, (F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("place"))


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """sources (source, source_size, weight, ...) with target: the shares of total after clamping.

    Each round is one aggregation to two numbers; the sources themselves stay distributed. A round
    clamps one source or more, else it is the last.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    level, left = None, None
    while True:
        clamped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        r = sources.agg(F.sum(F.when(clamped, cap).otherwise(0.0)), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))), F.sum(clamped.cast("long"))).first()
        if not r[1] or r[2] == left:
            break
        left, level = r[2], (total - r[0]) / r[1]
    return sources.withColumn("target", cap if level is None else F.when(F.col("weight") * F.lit(level) > cap, cap).otherwise(F.col("weight") * F.lit(level)))


def _order(id_col: str, seed: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(column(id_col).cast("string"), F.lit(""))))


def _dealt(docs: DataFrame, weights, share: float, max_epochs: float, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """One row per document: id, source, size, key (its place in the order), source_size, target, whole (repetitions of all), picked (once more)."""
    d = keep(docs.select(column(id_col).alias("id"), column(source_col).alias("source"), words(column(text_col)).alias("size"), _order(id_col, seed).alias("key")))
    sums = keep(d.groupBy("source", F.substring("key", 1, 4).alias("bucket")).agg(F.sum("size").alias("bucket_size")))
    sources = keep(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    s = ranked(sources)
    s = water_fill(s.withColumn("weight", weights(s).cast("double")), float(total), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    s = s.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # what stands before a bucket: 256 times 256 buckets, so that a window sees 256 sums at most
    hall = F.substring("bucket", 1, 2)
    earlier = Window.unboundedPreceding, -1
    halls = sums.groupBy(F.col("source").alias("of"), hall.alias("hall")).agg(F.sum("bucket_size").alias("hall_size"))
    halls = halls.withColumn("hall_start", F.coalesce(F.sum("hall_size").over(Window.partitionBy("of").orderBy("hall").rowsBetween(*earlier)), F.lit(0)))
    inner = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source", hall).orderBy("bucket").rowsBetween(*earlier)), F.lit(0))
    starts = sums.withColumn("inner", inner).join(halls, sums.source.eqNullSafe(F.col("of")) & (hall == F.col("hall"))).withColumn("start", F.col("inner") + F.col("hall_start"))
    starts = starts.select(F.col("source").alias("s"), "bucket", "start").join(s, F.col("s").eqNullSafe(s.source)).select("s", F.col("bucket").alias("b"), "start", "source_size", "target", "whole", "rest")
    d = d.withColumn("bucket", F.substring("key", 1, 4))
    d = d.join(starts, d.source.eqNullSafe(F.col("s")) & (d.bucket == F.col("b")))
    inside = Window.partitionBy("s", "b").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    picked = (2 * before + F.col("size") < 2 * F.col("rest")) & (F.col("size") > 0)
    return d.select("id", "source", "size", "key", "source_size", "target", "whole", picked.alias("picked"))


def shares(docs: DataFrame, weights, share: float = 1.0, max_epochs: float = 3.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: id, source, size, source_size, target, repeats, taken.

    weights: a function from a sources table (source, source_size, place) to a column of weights.
    """
    d = _dealt(docs, weights, share, max_epochs, seed, id_col, source_col, text_col).withColumn("repeats", F.col("whole") + F.col("picked").cast("long"))
    return d.select("id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights, share: float = 1.0, max_epochs: float = 3.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: every row of docs as often as its document is taken, all columns kept.

    What a source picks is the beginning of its order, so a row's repeats follow from its source's
    last picked (key, size): only that moves, not the texts. Of rows that are equal in both, as many
    as were picked come once more, the first by their texts.
    """
    d = keep(_dealt(docs, weights, share, max_epochs, seed, id_col, source_col, text_col).select("source", "key", "size", "whole", "picked"))
    ends = keep(d.groupBy("source").agg(F.max("whole").alias("whole"), F.max(F.when(F.col("picked"), F.struct("key", "size"))).alias("end")))
    n = ends.count()
    at_end = d.join(ids_hint(ends.select(F.col("source").alias("s"), "end"), n), F.col("source").eqNullSafe(F.col("s")) & (F.struct("key", "size") == F.col("end")))
    ties = at_end.groupBy("source").agg(F.count_if("picked").alias("of_end"), F.count("*").alias("at_end")).withColumnRenamed("source", "s")
    ends = keep(ends.join(ids_hint(ties, n), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("__qf_s"), "whole", "end", (F.col("of_end") < F.col("at_end")).alias("split"), "of_end"))
    names = [f"__qf_{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names).withColumn("__qf_key", _order(of[id_col], seed)).withColumn("__qf_size", words(F.col(of[text_col])))
    rows = rows.join(ids_hint(ends, n), F.col(of[source_col]).eqNullSafe(F.col("__qf_s")))
    here, tie = F.struct(F.col("__qf_key").alias("key"), F.col("__qf_size").alias("size")), F.col("split") & (F.struct(F.col("__qf_key").alias("key"), F.col("__qf_size").alias("size")) == F.col("end"))
    once = F.coalesce((F.col("__qf_size") > 0) & (here <= F.col("end")) & ~tie, F.lit(False))
    times = (F.col("whole") + once.cast("long")).cast("int")
    out = rows.withColumn("__qf_n", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*names)
    if not ends.filter("split").isEmpty():
        nth = F.row_number().over(Window.partitionBy("__qf_s").orderBy(F.xxhash64(of[text_col])))
        out = out.union(rows.filter(tie).withColumn("__qf_n", nth).filter(F.col("__qf_n") <= F.col("of_end")).select(*names))
    return out.toDF(*docs.columns)


def five_two_one(sources: DataFrame):
    """Weights 5, 2, 1 in turn, by the sources' order."""
    return F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (F.col("place") % 3 + 1).cast("int"))
