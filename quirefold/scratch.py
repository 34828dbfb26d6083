"""Intermediate tables in the folder that a cluster shares: computed once, read by all that follow."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's own folder below spark.checkpoint.dir; without one, a temporary folder in local mode, an error on a cluster."""
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='quirefold-')}"
        _FOLDERS[context.applicationId] = f"{base.rstrip('/')}/quirefold-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[context.applicationId])
    return _FOLDERS[context.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended already; the folder's owner cleans up
        return


def keep(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again, so that plans that share them don't compute them anew."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
