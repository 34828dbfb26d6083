"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import chat, exact_dedup, lm_score, media, mixing, near_dedup, pieces, quality, substring_dedup, warc
from quirefold.llm.common import documents, keep, remainder

#: Where the public tokenizers' files are; their path is a parameter of the operators.
TOKENIZERS = "/opt/tokenizers"
TOKENS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 5, 2, 1 in turn, three epochs at most."""
    s = mixing.shares(documents(spark, sf_dir), mixing.five_two_one)
    return s.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP1_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM s
), r AS (  -- by the level at which each source is full, the level that holds if it and all before it are clamped
  SELECT *, 3.0 * source_size / weight AS full_at,
         (total - coalesce(sum(3 * source_size) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w
  WINDOW o AS (ORDER BY 3.0 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT arg_min(level, full_at) FILTER (full_at >= level) AS level FROM r
), t AS (
  SELECT source, source_size, CASE WHEN weight * l.level > 3.0 * source_size THEN 3.0 * source_size ELSE weight * l.level END::DOUBLE AS target FROM w, l
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), p AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN size > 0 AND 2 * before + size < 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents, one row each."""
    g = exact_dedup.groups(documents(spark, sf_dir))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""



def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of rows whose crc32(doc_id) mod 3 is 1 are never seen."""
    x = keep(quality.features(documents(spark, sf_dir), "doc_id", "text"))
    rows = quality.labelled(x, documents(spark, sf_dir, "labels"), keep_in=lambda c: remainder(F.col(c), 3) != 1)
    s = quality.scored(x, quality.fit(rows))
    return s.select(F.col("id").alias("doc_id"), (remainder(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as Matroska audio and read back."""
    return media.summary(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op9_chat(spark: SparkSession, sf_dir: str, vocabulary: str | None = TOKENS) -> DataFrame:
    """All conversations and one that quotes control strings, formatted in windows and read back."""
    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.summary(chat.windows(rows, vocabulary=vocabulary))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, read back and merged into one index."""
    return warc.histories(documents(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_no")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_extract(url, '^[a-z]+://([^/?#]*)([^?#]*)([?][^#]*)?', ['host', 'path', 'query']) AS u FROM pages
), d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
    array_to_string(list_reverse(string_split(lower(u.host), '.')), ',') || ')' || CASE u.path WHEN '' THEN '/' ELSE u.path END || CASE u.query WHEN '?' THEN '' ELSE u.query END AS key FROM p
), g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to, row_number() OVER (ORDER BY key, page_id) AS capture_no FROM g
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents by their two-word shingles."""
    g = near_dedup.groups(documents(spark, sf_dir), k=2)
    return g.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.col("id").eqNullSafe(F.col("root")).alias("kept"))


OP6_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
                 ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2
), l AS (SELECT a, b FROM c WHERE 100 * common >= 80 * (na + nb - common)
), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id
), m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON s.doc_id = m.doc_id
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of passages of 35 words that also start elsewhere."""
    return substring_dedup.removed(documents(spark, sf_dir), length=35).withColumnRenamed("id", "doc_id")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d
), w AS (
  SELECT p.r, p.i, word, CASE WHEN p.i + 34 <= len(ws) THEN md5(array_to_string(ws[p.i:p.i + 34], ' ')) END AS h FROM p JOIN d ON p.r = d.r
), c AS (
  SELECT *, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM w
), m AS (
  SELECT *, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c
), k AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r
"""


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by models of those whose crc32(doc_id) mod 5 is not 1."""
    s = lm_score.scored(documents(spark, sf_dir), remainder(F.col("doc_id"), 5) != 1)
    return s.select(F.col("id").alias("doc_id"), (remainder(F.col("id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op2_pieces(spark: SparkSession, sf_dir: str, model_file: str = PIECES) -> DataFrame:
    """All documents encoded to pieces and decoded again."""
    return pieces.summary(documents(spark, sf_dir), model_file).withColumnRenamed("id", "doc_id")


QUERIES = {"op1_mixing": op1_mixing, "op8_exact_dedup": op8_exact_dedup, "op10_quality": op10_quality, "op3_media": op3_media, "op9_chat": op9_chat, "op5_warc": op5_warc, "op6_near_dedup": op6_near_dedup, "op7_substring_dedup": op7_substring_dedup, "op4_lm_score": op4_lm_score, "op2_pieces": op2_pieces}
ORACLES = {"op1_mixing": OP1_SQL, "op8_exact_dedup": OP8_SQL, "op5_warc": OP5_SQL, "op6_near_dedup": OP6_SQL, "op7_substring_dedup": OP7_SQL}
