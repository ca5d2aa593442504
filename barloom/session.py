"""Session helper for local runs and tests; a cluster supplies its own session."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession


def local_session(app: str = "barloom", cpus: str | int | None = None, shuffle: int | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BARLOOM_DRIVER_MEMORY", "6g"))
    )
    if "spark.checkpoint.dir" not in SparkConf().toDebugString():
        # a local run has no shared storage; a cluster names its own folder
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    return builder.getOrCreate()
