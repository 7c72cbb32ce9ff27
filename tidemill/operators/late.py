"""Late materialisation: a top-n that reads its other columns for the rows it returns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.joins import unused


def late_top(spark: SparkSession, path: str, order: list[Column], n: int, where: Column | None = None) -> DataFrame:
    """The first ``n`` rows of a Parquet table in an order, with all columns.

    A narrow scan, of the columns that the order and the filter read, finds the rows' files and places; a second scan opens
    those files alone (``n`` at most) and keeps the rows by a join to ``n`` places, which is broadcast. Worth it for wide
    rows and small ``n``; ties in the order are broken by whichever row comes first, as in any top-n.
    """
    whole = spark.read.parquet(path)
    file, row = unused(whole, "file", "row")
    place = [F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)]
    narrow = whole if where is None else whole.where(where)
    found = narrow.orderBy(*order).limit(n).select(*place).collect()
    if not found:
        return whole.limit(0)
    places = spark.createDataFrame(found, f"{file} string, {row} long")
    opened = spark.read.schema(whole.schema).parquet(*sorted({r[0] for r in found}))
    kept = opened.select("*", *place).join(F.broadcast(places), [file, row], "left_semi")
    return kept.drop(file, row).orderBy(*order)
