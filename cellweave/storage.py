"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one below /tmp only where none is named, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    return (top or f"file:///tmp/checkpoints/{os.getpid()}").rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A new path there, removed when the application ends."""
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back, which cuts the lineage; its rows survive lost executors."""
    path = fresh_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
