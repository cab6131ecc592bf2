"""Folders that driver and executors share, for tables that a query writes on its way or leaves behind."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; what is written there stays. Only a local session may leave that unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.gettempdir()
    return f"{named.rstrip('/')}/quaywave-{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path, deleted when the driver's JVM ends."""
    path = fresh(spark, name)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def settle(rows: DataFrame, name: str) -> DataFrame:
    """rows, written and read back: computed once, alike for all that read them, and kept if executors are lost."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
