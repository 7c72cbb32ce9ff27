"""Session construction and the few settings the engine's semantics rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: UTC keeps zone-less and zoned timestamps aligned; ANSI makes bad casts and overflow fail.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

#: Runtime re-planning: small partitions are merged, skewed joins are split.
PHYSICAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "tidemill", cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session; on a cluster, build your own and call :func:`configure`."""
    partitions = str(os.cpu_count() if cpus == "*" else cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", partitions)
    )
    for key, value in {**SEMANTIC_CONF, **PHYSICAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def configure(spark: SparkSession) -> SparkSession:
    """Set what results depend on; leave physical choices to the caller."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    return spark
