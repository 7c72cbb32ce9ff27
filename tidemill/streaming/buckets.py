"""Tumbling buckets as a stream: beyond the reference, the streaming form of ``time_bucket``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.compat import BUCKET_ORIGIN_US
from tidemill.session import shared_dir


def bucketed(events: DataFrame, width_us: int = 3600 * 10**6, late: str = "1 hour") -> DataFrame:
    """Counts of each bucket and event type; of a stream, state of buckets that ended before the watermark is dropped."""
    timed = events.withColumn("_at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    bucket = F.window("_at", f"{width_us} microseconds", startTime=f"{BUCKET_ORIGIN_US % width_us} microseconds")
    return timed.groupBy(bucket.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "event_type", "n")


def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads the events table as a file stream, runs it to its end and returns the buckets.

    Each batch writes the buckets it changed as Parquet, a repeated batch over its own earlier files; the last count of a bucket holds. State and files are in the
    folder that driver and executors share.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = f"{shared_dir(spark)}/buckets-{uuid.uuid4().hex}"

    def save(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    query = bucketed(events).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("bucket", "event_type").agg(F.max_by("n", "batch").alias("n"))
