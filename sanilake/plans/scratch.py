"""Folders for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where spark.checkpoint.dir is, or on one machine alone in Spark's own temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark._jvm.java.lang.System.getProperty("java.io.tmpdir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
