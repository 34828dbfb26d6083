"""The pipeline from raw documents to training sequences: five stages, each written and read again.

Quality classifier, exact dedup, near-dedup, mixing to target weights, encoding to pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import exact_dedup, mixing, near_dedup, pieces, quality
from quirefold.llm.common import documents, keep
from quirefold.llm.queries import PIECES


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labelled ones."""
    return quality.keep_good(docs, documents(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.dedup(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs, mixing.five_two_one)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row."""
    rows = pieces.encode(docs.select("doc_id", "source", "text"), PIECES)
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [("quality classifier", classify), ("exact dedup", drop_copies), ("near-dedup", drop_near_copies), ("mixing", mix), ("pieces", encode)]

#: The classifier, the sketches and the pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs)
    return docs
