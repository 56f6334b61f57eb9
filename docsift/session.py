"""Session defaults; a cluster's own settings always win over these."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, name: str = "docsift", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    conf = DEFAULTS | {
        "spark.master": f"local[{cores}]",
        "spark.app.name": name,
        "spark.driver.memory": os.environ.get("DOCSIFT_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": str(cores),
    }
    conf |= extra
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
