"""Access to the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.session import configure

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, lazily; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> SparkSession:
    """Register the named tables as temporary views."""
    configure(spark)
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark
