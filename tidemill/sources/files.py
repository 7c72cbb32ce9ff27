"""Sources: Parquet by glob with a strict schema, series, text and Arrow ingest."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _matched(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return [str(s.getPath()) for s in found or []]


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """All files that a glob matches (``*`` stays inside a path segment); their columns and types must agree."""
    files = _matched(spark, path)
    if not files:
        raise FileNotFoundError(path)
    first = spark.read.parquet(files[0]).schema
    shape = lambda s: [(f.name, f.dataType) for f in s.fields]
    for other in files[1:]:  # footers only
        if shape(spark.read.parquet(other).schema) != shape(first):
            raise ValueError(f"{other} has other columns than {files[0]}")
    return spark.read.schema(first).parquet(*files)


def series(spark: SparkSession, start: int, stop: int | None = None, step: int = 1) -> DataFrame:
    """``range``: stop exclusive."""
    start, stop = (0, start) if stop is None else (start, stop)
    if step == 0:
        raise ValueError("step must not be 0")
    return spark.range(start, stop, step).withColumnRenamed("id", "range")


def generate_series(spark: SparkSession, start: int, stop: int | None = None, step: int = 1) -> DataFrame:
    """``generate_series``: stop inclusive."""
    start, stop = (0, start) if stop is None else (start, stop)
    if step == 0:
        raise ValueError("step must not be 0")
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", "generate_series")


def values(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Rows as a table."""
    return spark.createDataFrame(list(rows), schema)


def copy_text(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = "\t", null: str = "\\N") -> DataFrame:
    """Lines of one file of delimited text with backslash escapes, up to a line ``\\.``; any bad line fails the whole read.

    Parsed in the JVM: a line is cut at delimiters without a backslash before them, and a field into escapes and what is between.
    Only an unescaped ``null`` string is NULL. Several files have no order of lines, so they are refused.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    lines = spark.read.option("lineSep", "\n").text(path)
    if len(lines.inputFiles()) > 1:
        raise ValueError(f"{path} has several files; text is read from one")
    lines = lines.withColumn("_end", F.col("value") == "\\.").withColumn("_at", F.monotonically_increasing_id())  # a file's splits come in order
    end = lines.where("_end").agg(F.min("_at")).first()[0]
    body = lines.where(F.lit(True) if end is None else F.col("_at") < end)
    mark = re.escape(delimiter)
    field = rf"([^\\{mark}]*+(?:\\.[^\\{mark}]*+)*+){mark}"
    body = body.select(F.regexp_extract_all(F.concat("value", F.lit(delimiter)), F.lit(field), F.lit(1)).alias("p"))
    bad = F.raise_error(F.concat(F.lit(f"expected {len(fields)} columns, found "), F.size("p").cast("string")))
    body = body.select(F.when(F.size("p") == len(fields), F.col("p")).otherwise(bad.cast("array<string>")).alias("p"))

    def plain(c):
        def decoded(e):
            out = F.when(~e.startswith("\\"), e)
            for name, char in (("b", "\b"), ("f", "\f"), ("n", "\n"), ("r", "\r"), ("t", "\t"), ("v", "\v")):
                out = out.when(e == "\\" + name, F.lit(char))
            out = out.when(e.rlike(r"\A\\x[0-9A-Fa-f]"), F.chr(F.conv(F.substring(e, 3, 2), 16, 10).cast("bigint")))
            out = out.when(e.rlike(r"\A\\[0-7]"), F.chr(F.conv(F.substring(e, 2, 3), 8, 10).cast("bigint")))
            return out.otherwise(F.substring(e, 2, 2**31 - 1))

        parts = F.regexp_extract_all(c, F.lit(r"\\x[0-9A-Fa-f]{1,2}|\\[0-7]{1,3}|\\.|[^\\]+"), F.lit(0))
        return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(parts, decoded), "")).otherwise(c)

    return body.select(*[F.when(F.col("p")[i] == null, F.lit(None)).otherwise(plain(F.col("p")[i])).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def copy_arrow(spark: SparkSession, stream: bytes, schema: T.StructType | str) -> DataFrame:
    """An Arrow IPC stream; columns go by position and are cast to the target."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    with pa.ipc.open_stream(stream) as reader:
        table = reader.read_all()
    if table.num_columns != len(fields):
        raise ValueError(f"expected {len(fields)} columns, found {table.num_columns}")
    frame = spark.createDataFrame(table.rename_columns([f"c{i}" for i in range(len(fields))]))
    return frame.select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])
