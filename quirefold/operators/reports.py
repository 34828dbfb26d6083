"""Validator reports: messages, their places and sums by severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REPORT = "messages array<struct<ID:string, severity:string, message:string, locations:array<string>, additionalLocations:bigint>>"
SEVERE = ("FATAL", "ERROR")


def messages(reports: DataFrame) -> DataFrame:
    """(doc_id, message_no, severity, code, message, occurrences) of reports (doc_id, json); a message without places counts once."""
    d = reports.select("doc_id", F.posexplode(F.from_json("json", REPORT)["messages"]).alias("i", "m"))
    n = F.coalesce(F.size("m.locations"), F.lit(0)) + F.coalesce("m.additionalLocations", F.lit(0))
    return d.select("doc_id", (F.col("i") + 1).alias("message_no"), F.upper("m.severity").alias("severity"), F.col("m.ID").alias("code"), F.col("m.message").alias("message"), F.greatest(F.lit(1), n).cast("long").alias("occurrences"))


def rollup(found: DataFrame) -> DataFrame:
    """(doc_id, severity, occurrences, messages)."""
    return found.groupBy("doc_id", "severity").agg(F.sum("occurrences").cast("long").alias("occurrences"), F.count("*").alias("messages"))


def rendered(found: DataFrame) -> DataFrame:
    text = F.format_string("%s(%s): %s [%d occurrence(s)]", "severity", F.coalesce("code", F.lit("")), F.coalesce("message", F.lit("")), "occurrences")
    return found.withColumn("text", text)


def first(found: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key with their rank; a partial top-n runs before the shuffle's sort."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("rank") <= n)


def publishable(found: DataFrame, docs: DataFrame) -> DataFrame:
    """docs whose report has neither a fatal message nor an error."""
    return docs.join(found.filter(F.col("severity").isin(*SEVERE)).select("doc_id").distinct(), "doc_id", "left_anti")
