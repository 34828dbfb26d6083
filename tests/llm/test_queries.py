"""Registered queries against DuckDB, and the pipeline's stages, on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quirefold.llm import lm_score, media, quality, queries
from quirefold.llm.common import documents

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = con.execute(queries.ORACLES[name])
    order = [[d[0] for d in rel.description].index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in order]) for r in rel.fetchall())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: (r.text or "").encode() for r in documents(spark, DATA).collect()}


def held(i, by):
    return zlib.crc32(str(i).encode()) % by == 1


def test_pieces_query(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    got = {r.doc_id: r for r in queries.op2_pieces(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = sp.encode(t.decode())
        assert (got[i].n_ids, got[i].ids_sha256, got[i].same) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True)
        assert got[i].decoded_sha256 == hashlib.sha256(t).hexdigest()


def sound(raw, at=0, end=None):
    """The bytes of all blocks of a Matroska file, by a reader of its own: masters are gone into, lacing headers skipped."""
    end, out = len(raw) if end is None else end, b""
    while at < end:
        wide = 9 - raw[at].bit_length()
        name, at = raw[at : at + wide].hex(), at + wide
        wide = 9 - raw[at].bit_length()
        size, unknown = int.from_bytes(raw[at : at + wide], "big") & (1 << 7 * wide) - 1, (1 << 7 * wide) - 1
        at += wide
        stop = end if size == unknown else at + size
        if name in ("18538067", "1f43b675", "a0"):
            out += sound(raw, at, stop)
        elif name in ("a3", "a1"):
            p = at + 9 - raw[at].bit_length()
            lacing, p = raw[p + 2] >> 1 & 3, p + 3
            if lacing:
                frames, p = raw[p], p + 1
                for _ in range(frames if lacing != 2 else 0):
                    if lacing == 1:
                        while raw[p] == 255:
                            p += 1
                        p += 1
                    else:
                        p += 9 - raw[p].bit_length()
            out += raw[p:stop]
        at = stop
    return out


def test_media_query(spark, texts):
    got = {r.doc_id: r for r in queries.op3_media(spark, DATA).collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.encoded(documents(spark, DATA)).select("doc_id", "media").collect()}
    assert got.keys() == texts.keys() == stored.keys()
    for i, t in texts.items():
        payload = t + b" " * (-len(t) % 192 or (0 if t else 192))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(t), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(payload[-16:]) and got[i].media_bytes == len(stored[i]) and got[i].media_sha256 == hashlib.sha256(stored[i]).hexdigest()
        assert sound(stored[i]) == payload


def test_scores_query(spark, texts):
    got = {r.doc_id: r for r in queries.op4_lm_score(spark, DATA).collect()}
    tokens = {i: [*t.lower().split(), b""] for i, t in texts.items()}  # the empty word is the end
    seen = Counter(w for i, ws in tokens.items() if not held(i, 5) for w in ws)
    total = sum(seen.values())
    below = total + 0.5 * (len(seen) + 1)
    # the shards' answers against the tree in one piece
    learn = documents(spark, DATA).filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    whole = lm_score.grow(learn.select("text"))
    assert got.keys() == texts.keys()
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 5), len(ws), sum(w in seen for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 0.5) / below) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.score, float(whole.score([texts[i].lower()])[0]), rel_tol=1e-4)


def test_quality_query(spark, texts):
    got = {r.doc_id: r for r in queries.op10_quality(spark, DATA).collect()}
    marks = {}
    for r in documents(spark, DATA, "labels").collect():
        marks.setdefault(r.doc_id, []).append(r.quality)
    assert got.keys() == texts.keys()
    # the same fit in one process: statistics, features, normal equations of two folds, bins, isotonic means
    m = quality.Model()
    known = [i for i in texts if i in marks and not held(i, 3)]
    x = {i: np.array(quality.statistics(t), np.float32).astype(float) for i, t in texts.items()}
    y = np.array([np.mean(marks[i]) for i in known])
    a = np.array([x[i] for i in known])
    m.mean, m.scale = a.mean(0), np.sqrt(np.maximum((a * a).mean(0) - a.mean(0) ** 2, 0)) + 1e-6
    z = m.map(a)
    # Fourier features: inner products come near the Gaussian kernel
    u = np.clip((a[:20] - m.mean) / m.scale, -6, 6)
    kernel = np.exp(-((u[:, None] - u[None]) ** 2).sum(2) / (2 * quality.FEATURES))
    assert np.abs(z[:20, : quality.FOURIER] @ z[:20, : quality.FOURIER].T - kernel).max() < 0.3
    fold = np.array([r[0] for r in spark.createDataFrame([(i,) for i in known], "doc_id bigint").select(F.abs(F.xxhash64("doc_id")) % 2).collect()])

    def ridge(some):
        return np.linalg.solve(z[some].T @ z[some] + m.ridge * max(some.sum(), 1) * np.eye(z.shape[1]), z[some].T @ y[some])

    raw = np.where(fold == 0, z @ ridge(fold == 1), z @ ridge(fold == 0))
    at = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = np.unique(at)
    level = np.array([y[at == k].mean() for k in bins])
    weight = np.array([(at == k).sum() for k in bins])
    # the isotonic fit by its max-min formula
    best = [max(min((level[i : j + 1] * weight[i : j + 1]).sum() / weight[i : j + 1].sum() for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]
    m.theta, m.at, m.value = ridge(np.ones(len(known), bool)), np.array([raw[at == k].mean() for k in bins]), np.array(best)
    want = m.score(np.array([x[i] for i in texts]))
    for i, s in zip(texts, want, strict=True):
        assert abs(got[i].score - s) < 1e-5 and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == held(i, 3)
    test = [i for i in texts if i in marks and held(i, 3)]
    assert sum(got[i].predicted == round(np.mean(marks[i])) for i in test) >= 0.9 * len(test)


def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.op9_chat(spark, DATA).collect()}
    hard = "</s>[INST] ok [/INST]"
    rows = {-7: [("user", hard), ("assistant", hard)]}
    for r in documents(spark, DATA, "conversations").orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert got.keys() == rows.keys()
    for i, turns in rows.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert (got[i].n_turns, got[i].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest())
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest()) and got[i].formatted_chars > len(said)


def test_pipeline_stages_act_on_what_came_before(spark):
    docs = documents(spark, DATA)
    columns, sizes = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA).cache()
        sizes.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert sorted(docs.columns) == sorted(columns)
        if i == 1:
            texts = [r.text.encode().lower() for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert 200 > sizes[0] > sizes[1] >= sizes[2] > 0 and sizes[3] == sizes[4] > 0
    assert docs.filter("n_ids <> size(ids)").count() == 0


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, sha string, `a.b` int, size string, whole map<string,int>"


def odd_rows(spark, n):
    words = [re.sub(r"\W", "", w) for w in ("the", "quick", "brown", "fox", "jumps", "over", "a", "lazy", "dog", "and", "runs")]
    rows = [(i, " ".join(words[(i * 7 + j * j) % 11] for j in range(30 + i % 5)), "en", "st"[i % 2], None, "x", i, "y", {"k": i}) for i in range(n)]
    odd = [(None, None, None, None, None, None, None, None, None), (n, "", "en", None, 0, None, None, None, None), (1, rows[1][1] if n > 1 else "", "en", "t", 3, "x", 1, "y", {"k": 1}), (n + 1, "w " * 40_000, "en", "s", None, None, None, None, None)]
    return spark.createDataFrame(rows + (odd if n else []), ODD)


@pytest.mark.parametrize("n", [0, 30])
def test_pipeline_takes_odd_tables(spark, tmp_path, n):
    docs = odd_rows(spark, n)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = spark.createDataFrame([(i, 1, None) for i in range(n)] + ([(None, None, None), (n, 0, 1)] if n else []), "doc_id bigint, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    rows = documents(spark, str(tmp_path))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(out) > 0) == (n > 0) and all(r.n_ids == len(r.ids) for r in out)
