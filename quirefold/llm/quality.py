"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a text are standardised and mapped by seeded random Fourier features, whose inner
products approximate a Gaussian kernel. Every partition sums its part of the normal equations; a
tree of sums brings them to one system of fixed size, which is solved on the driver. Two folds of
the labelled rows score each other, and isotonic regression over those scores (in bins of fixed
number) turns scores into probabilities; the final model uses both folds.

Nothing but the text enters a score. Only statistics of fixed size reach the driver.

Cases: null texts count as empty and get a score as well; several labels of a document are
averaged, null labels ignored; repeated rows count as often as they stand; without any labelled
row the score is 0.5; an empty table gives an empty result; very long texts are read whole;
other columns pass through keep_good().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import bounded_batches, ids_hint, keep, tidied, utf8

FEATURES = 24
FOURIER = 256
BINS = 1024
FAN_IN = 16

_CLASS = np.full(256, 7)  # of each byte: 0 lower, 1 upper, 2 digit, 3 space, 4 line feed, 5 ordinary marks, 6 other marks, 7 beyond ASCII
for _k, _of in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9), (10, 13), b".,;:'\"!?()-", (), ())):
    _CLASS[list(_of)] = _k
_CLASS[[x for x in range(128) if _CLASS[x] == 7]] = 6
_CLASSES = np.eye(8)[_CLASS]


def statistics(text: bytes) -> list[float]:
    """FEATURES numbers of one text; an empty one has a defined value for each."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / max(n, 1)
    classes = share @ _CLASSES
    some = share[share > 0]
    words = text.split()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    m = max(len(words), 1)
    lines = text.split(b"\n")
    bare = [x for x in lines if x.strip()]
    lower = {w.lower() for w in words}
    ends = np.fromiter((w[-1] for w in words), np.int64, len(words))
    odd_end = float(_CLASSES[ends, 6].sum()) / m if len(words) else 0.0
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 0
    return [
        np.log1p(n), np.log1p(len(words)), float(sizes.mean()) if len(words) else 0.0, float(sizes.std()) if len(words) else 0.0, float(np.log1p(sizes.max())) if len(words) else 0.0,
        *classes, -float((some * np.log2(some)).sum()) if n else 0.0,
        len(lower) / m, pairs / max(m - 1, 1), np.log1p(len(bare)), len(set(bare)) / max(len(bare), 1), np.log1p(n / max(len(bare), 1)),
        odd_end, float((sizes == 1).sum()) / m, float(share[33]) * 10, float(share[124]) * 10, float((share[35] + share[36] + share[37] + share[38] + share[42])) * 10,
    ]


def features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of every row as packed doubles."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(statistics(t), "<f4").tobytes() for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["id", "x"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), f"id {kind}, x binary")


def _tree(parts: DataFrame) -> np.ndarray | None:
    """The sum of packed vectors (part, v), added up FAN_IN at a time; the order of adding is fixed."""

    def add(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("part").to_numpy(), kind="stable")
        v = t.column("v").to_pylist()
        total = np.frombuffer(v[order[0]], "<f8").copy()
        for i in order[1:]:
            total += np.frombuffer(v[i], "<f8")
        return pa.table({"part": pa.array([int(t.column("part")[0].as_py()) // FAN_IN]), "v": pa.array([total.tobytes()], pa.binary())})

    parts = keep(parts)
    while (top := parts.agg(F.max("part")).first()[0]) is not None and top >= FAN_IN:
        parts = keep(parts.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(add, "part bigint, v binary"))
    total = None
    for r in sorted(parts.collect(), key=lambda r: r.part):
        v = np.frombuffer(r.v, "<f8")
        total = v.copy() if total is None else total + v
    return total


class Model:
    """Standardisation, Fourier weights, ridge weights and the calibration's steps: a few hundred KB at any size."""

    def __init__(self, seed: int = 11, ridge: float = 1e-3, width: float = 1.0):
        r = np.random.default_rng(seed)
        self.w = r.standard_normal((FEATURES, FOURIER)) / (width * np.sqrt(FEATURES))
        self.b = r.uniform(0, 2 * np.pi, FOURIER)
        self.ridge, self.mean, self.scale = ridge, np.zeros(FEATURES), np.ones(FEATURES)
        self.theta, self.at, self.value = np.zeros(FOURIER + FEATURES + 1), np.array([0.0]), np.array([0.5])

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FOURIER) * np.cos(z @ self.w + self.b), z / 10, np.ones((len(x), 1))])

    def solve(self, sums: np.ndarray) -> np.ndarray:
        k = FOURIER + FEATURES + 1
        a, b, n = sums[: k * k].reshape(k, k), sums[k * k : k * k + k], sums[-1]
        return np.linalg.solve(a + self.ridge * max(n, 1) * np.eye(k), b)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.map(x) @ self.theta, self.at, self.value), 0.0, 1.0)


def unpack(x) -> np.ndarray:
    return np.frombuffer(b"".join(x), "<f4").reshape(-1, FEATURES).astype(np.float64)


def _sums(rows: DataFrame, of, width: int) -> np.ndarray:
    """Sums over all rows (x, y, fold) of what of(x, y, fold) returns for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, part = np.zeros(width), TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                total += of(unpack(b.column(0).to_pylist()), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "v"])

    got = _tree(rows.select("x", "y", "fold").mapInArrow(tidied(run), "part bigint, v binary"))
    return np.zeros(width) if got is None else got


def isotonic(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means closest to total / n, by bin."""
    level: list[list[float]] = []
    for k, t in zip(n, total, strict=True):
        level.append([k, t, 1])
        while len(level) > 1 and level[-2][1] * level[-1][0] >= level[-1][1] * level[-2][0]:
            k2, t2, m = level.pop()
            level[-1] = [level[-1][0] + k2, level[-1][1] + t2, level[-1][2] + m]
    return np.concatenate([np.full(int(m), t / k) for k, t, m in level]) if level else np.array([])


def fit(rows: DataFrame, **how) -> Model:
    """rows (x, y, fold 0 or 1), all of them: three sums over the rows, each of fixed size."""
    m, k = Model(**how), FOURIER + FEATURES + 1
    s = _sums(rows, lambda x, y, fold: np.concatenate([x.sum(0), (x * x).sum(0), [len(x), y.sum()]]), 2 * FEATURES + 2)
    n = s[-2]
    if not n:
        return m
    m.mean = s[:FEATURES] / n
    m.scale = np.sqrt(np.maximum(s[FEATURES : 2 * FEATURES] / n - m.mean**2, 0)) + 1e-6
    one = k * k + k + 1

    def normal(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        z, out = m.map(x), []
        for f in (0, 1):
            zf, yf = z[fold == f], y[fold == f]
            out += [(zf.T @ zf).ravel(), zf.T @ yf, [len(zf)]]
        return np.concatenate(out)

    s = _sums(rows, normal, 2 * one)
    crossed = [m.solve(s[one:]), m.solve(s[:one])]  # the other fold's weights
    low, high = -0.5, 1.5

    def binned(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        z = m.map(x)
        raw = np.where(fold == 0, z @ crossed[0], z @ crossed[1])
        at = np.clip(((raw - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)])

    c = _sums(rows, binned, 3 * BINS)
    m.theta = m.solve(s[:one] + s[one:])
    full = c[:BINS] > 0
    m.at, m.value = c[2 * BINS :][full] / c[:BINS][full], isotonic(c[:BINS][full], c[BINS : 2 * BINS][full])
    return m


def labelled(x: DataFrame, labels: DataFrame, label: str = "quality", keep_in=None) -> DataFrame:
    """(x, y, fold) of the rows that have a label; keep_in: a condition on id."""
    y = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).cast("double").alias("y"))
    y = y.filter(keep_in("doc_id")) if keep_in else y
    return keep(x.join(y, x.id == y.doc_id).select("x", "y", (F.abs(F.xxhash64("doc_id")) % 2).alias("fold")))


def scored(x: DataFrame, model: Model) -> DataFrame:
    """(id, score) of (id, x)."""
    shared = x.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(unpack(b.column(1).to_pylist())) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["id", "score"])

    return x.mapInArrow(tidied(run), f"id {x.schema['id'].dataType.simpleString()}, score double")


def score_column(spark, model: Model, text: Column) -> Column:
    """The score of a text column, computed where the rows are."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(t: pd.Series) -> pd.Series:
        x = [statistics(v) for v in utf8(pa.array(t, pa.string()))]
        return pd.Series(shared.value.score(np.array(x, np.float32).astype(float).reshape(-1, FEATURES)))

    return run(text)


def keep_good(docs: DataFrame, labels: DataFrame, keep_in=None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that the classifier accepts, with all their columns.

    Scores are computed where the rows are. Labelled documents are found by a broadcast of the
    labels' ids; with more of them than that allows, the documents meet them by a shuffle.
    """
    ids = labels.select(F.col("doc_id").alias("__qf_id")).distinct()
    known = docs.select(F.col(id_col), F.col(text_col)).join(ids_hint(ids, ids.count()), F.col(id_col) == F.col("__qf_id"), "left_semi")
    model = fit(labelled(features(known, id_col, text_col), labels, keep_in=keep_in))
    return docs.filter(score_column(docs.sparkSession, model, F.col(text_col)) >= least)
