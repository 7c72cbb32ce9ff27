"""What the training-data operators share: columns of the documents table, splits, shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes in an Arrow batch; a row that is longer is a batch of its own.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches for the session from here on, so that a Python worker's memory is bounded by a few MB of text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stash(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors.

    The files are removed when the application's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a stashed table that nothing will read again."""
    path = getattr(df, "_tidemill_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_hashes(text: str = "text") -> tuple[Column, Column]:
    """Two 64-bit hashes that, beside doc_id, tell rows apart whose ids repeat; equal for equal texts."""
    return F.xxhash64(F.lit(1), F.col(text)), F.xxhash64(F.lit(2), F.col(text))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes for the frame not to have them."""
    taken = {c.lower() for c in df.columns}
    lead = "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def widened(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df with more fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])
