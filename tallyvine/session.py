"""Session settings: a local session for tests and benchmarks, and sizes for a cluster."""

from __future__ import annotations

from math import ceil

from pyspark.sql import SparkSession


def settings_for(input_bytes: int, partition_bytes: int = 200 * 1024**2) -> dict[str, str]:
    """Settings under which a shuffle of ``input_bytes`` has partitions that fit in memory.

    Small shuffles are merged, and hot partitions split, by adaptive execution.
    """
    return {
        "spark.sql.shuffle.partitions": str(max(200, ceil(input_bytes / partition_bytes))),
        "spark.sql.files.maxPartitionBytes": "256MB",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
    }


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "tallyvine") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Tests count executions; beyond this number, 1000 by default, the count stands still.
        .config("spark.sql.ui.retainedExecutions", "20000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
