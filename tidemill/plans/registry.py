"""All queries of the engine and their SQL: name -> callable, name -> text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans.catalogue import SQL, duckdb_sql, spark_sql
from tidemill.plans.frames import FRAMES
from tidemill.session import configure
from tidemill.tables import TABLES, views


def _of_sql(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text = spark_sql(name)
    used = [t for t in TABLES if t in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views(spark, sf_dir, *used).sql(text) if used else configure(spark).sql(text)

    return run


def _configured(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(configure(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{n: _of_sql(n) for n in SQL}, **{n: _configured(f) for n, (f, _) in FRAMES.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{n: duckdb_sql(n) for n in SQL}, **{n: o for n, (_, o) in FRAMES.items() if o}}
