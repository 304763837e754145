"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A stored table cuts the lineage: whatever is read from it later does not depend on
executors that may be gone by then, and two passes over it see the same rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyvine-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{_shared_folder(spark).rstrip('/')}/tallyvine-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return it as read back from storage."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
