"""Documents as a stream of files: the plans are stateless per document, so they run on micro-batches unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.operators import structure
from quirefold.sources import text


def stream_outlines(spark: SparkSession, folder: str, target: str, checkpoint: str, schema: str = "doc_id bigint, text string"):
    """Starts a query that appends the outline of every new document in folder (parquet) to target (parquet).

    A document's rows come in one file, so each micro-batch has whole documents; the batch id names
    the output folder, so that a repeated batch replaces its own output.
    """

    def write(batch: DataFrame, number: int) -> None:
        structure.sections(structure.blocks(text.lines(batch))).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
