"""Session settings the operators are tuned for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Splitting a skewed join partition pays even when it costs one more shuffle,
# because identity keys (a copied record, a shared DOI) can be very hot.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows sent to Python hold whole texts, so a batch has few of them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A checkpoint goes with the last DataFrame that reads it.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: str | int | None = None, app: str = "reviewlake") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cores = str(cpus or os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="reviewlake-checkpoint-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
