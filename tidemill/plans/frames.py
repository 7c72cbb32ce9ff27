"""Catalogue entries written with the DataFrame API, with their DuckDB SQL."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import compat as C
from tidemill.operators.joins import mark_join, range_join
from tidemill.operators.late import late_top
from tidemill.session import shared_dir
from tidemill.sources import files
from tidemill.sources.store import Store
from tidemill.streaming.buckets import stream_buckets
from tidemill.tables import table

Query = Callable[[SparkSession, str], DataFrame]
FRAMES: dict[str, tuple[Query, str | None]] = {}


def entry(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FRAMES[name] = (f, oracle)
        return f

    return add


def _column(name: str, source: str, key: str, build: Callable, oracle: str) -> None:
    """A query of one computed column beside the table's key."""
    FRAMES[name] = (lambda spark, d: table(spark, d, source).select(key, build().alias("v")), f"select {key}, {oracle} as v from {source}")


_column("str_length_bytes", "documents", "doc_id", lambda: C.byte_length("text"), "strlen(text)")
_column("str_contains", "documents", "doc_id", lambda: F.contains("text", F.lit("token")), "contains(text, 'token')")
_column("str_prefix", "pages", "page_id", lambda: F.startswith("url", F.lit("https://")), "prefix(url, 'https://')")
_column("str_suffix", "pages", "page_id", lambda: F.endswith("url", F.lit("/")), "suffix(url, '/')")
_column("str_like", "pages", "page_id", lambda: C.like("url", "%//%.example.%/_%"), "url like '%//%.example.%/_%'")
_column("str_like_backslash", "part", "p_partkey", lambda: C.like(F.concat("p_brand", F.lit("\\%")), "%\\%"), "(p_brand || '\\%') like '%\\%'")
_column("str_substring", "documents", "doc_id", lambda: C.substring("text", 3, 5), "substring(text, 3, 5)")
_column("str_substring_zero", "documents", "doc_id", lambda: C.substring("text", 0, 3), "substring(text, 0, 3)")
_column("str_substring_rest", "pages", "page_id", lambda: C.substring("url", 9), "substring(url, 9)")
_column("str_full_match", "part", "p_partkey", lambda: C.regexp_full_match("p_brand", "Brand#[1-3]."), "regexp_full_match(p_brand, 'Brand#[1-3].')")
_column("str_replace_first", "documents", "doc_id", lambda: C.regexp_replace_first("text", "([a-z])([a-z]+) ", "<\\2$\\1>"), "regexp_replace(text, '([a-z])([a-z]+) ', '<\\2$\\1>')")
_column("str_replace_whole", "pages", "page_id", lambda: C.regexp_replace_first("url", "e.", "[\\0]"), "regexp_replace(url, 'e.', '[\\0]')")
_column("str_jit_replace", "pages", "page_id", lambda: C.regexp_jit_replace("url", "(ex)(am)", "\\2\\1"), "regexp_replace(url, '(ex)(am)', '\\2\\1')")
_column("cb_regex_domain", "pages", "page_id", lambda: C.regexp_replace_first("url", "^https?://(?:www\\.)?([^/]+)/.*$", "\\1"), "regexp_replace(url, '^https?://(?:www\\.)?([^/]+)/.*$', '\\1')")
_column("str_format_bytes", "documents", "doc_id", lambda: C.format_bytes(F.expr("n_chars * n_chars * n_chars")), "format_bytes(n_chars * n_chars * n_chars)")
_column("num_arith", "lineitem", "l_orderkey", lambda: F.expr("(l_quantity + 1) * 2 - l_linenumber"), "(l_quantity + 1) * 2 - l_linenumber")
_column("num_divide", "lineitem", "l_orderkey", lambda: C.divide("l_quantity", F.expr("l_linenumber - 1")), "l_quantity / cast(l_linenumber - 1 as double)")
_column("num_floor", "lineitem", "l_orderkey", lambda: C.floor_double(F.expr("l_extendedprice / 7")), "floor(l_extendedprice / 7)")
_column("num_floor_decimal", "lineitem", "l_orderkey", lambda: C.floor_decimal(F.expr("cast(l_extendedprice as decimal(12,2))"), 12), "cast(floor(cast(l_extendedprice as decimal(12,2))) as decimal(12,0))")
_column("num_round", "lineitem", "l_orderkey", lambda: C.round_half_away(F.expr("l_extendedprice * l_tax"), 1), "round(l_extendedprice * l_tax, 1)")
_column("num_round_negative", "lineitem", "l_orderkey", lambda: C.round_half_away("l_extendedprice", -3), "round(l_extendedprice, -3)")
_column("num_decimal", "lineitem", "l_orderkey", lambda: F.expr("cast(cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(15,2))) as decimal(30,4))"), "cast(cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(15,2))) as decimal(30,4))")
_column("dt_trunc_hour", "events", "event_id", lambda: C.date_trunc("hour", "ts"), "date_trunc('hour', ts)")
_column("dt_bucket_fixed", "events", "event_id", lambda: C.time_bucket(15 * 60 * 10**6, "ts"), "time_bucket(interval '15 minutes', ts)")
_column("dt_bucket_month", "events", "event_id", lambda: C.time_bucket_months(3, "ts"), "cast(time_bucket(interval '3 months', cast(ts as date)) as date)")
_column("dt_bucket_month_origin", "events", "event_id", lambda: C.time_bucket_months(4, "ts", (2000, 2)), "cast(time_bucket(interval '4 months', cast(ts as date), date '2000-02-01') as date)")
_column("dt_bucket_origin", "events", "event_id", lambda: C.time_bucket(7 * 3600 * 10**6, "ts", 1_600_000_000_000_000), "time_bucket(interval '7 hours', ts, make_timestamp(1600000000000000))")
_column("dt_make_date", "orders", "o_orderkey", lambda: C.make_date(F.expr("cast(o_orderkey % 20000 as int)")), "date '1970-01-01' + cast(o_orderkey % 20000 as integer)")
_column("dt_make_timestamp", "orders", "o_orderkey", lambda: C.make_timestamp(F.expr("o_orderkey * 1000003")), "make_timestamp(o_orderkey * 1000003)")
_column("dt_plus_interval", "events", "event_id", lambda: F.expr("ts + interval '3' day - interval '90' minute"), "ts + interval '3 days' - interval '90 minutes'")
_column("dt_date_plus", "orders", "o_orderkey", lambda: F.expr("date_add(cast(o_orderdate as date), 30)"), "cast(o_orderdate as date) + 30")
_column("dt_diff", "events", "event_id", lambda: C.micros("ts") - F.lit(1_600_000_000_000_000), "epoch_us(ts - make_timestamp(1600000000000000))")
_column("dt_interval_order", "orders", "o_orderkey", lambda: C.normalized_interval_us(F.expr("o_orderkey % 3"), F.expr("o_orderkey % 40"), F.lit(0)) > C.normalized_interval_us(F.lit(1), F.lit(0), F.lit(0)), "to_months(cast(o_orderkey % 3 as integer)) + to_days(cast(o_orderkey % 40 as integer)) > interval '1 month'")

_PARTS = ("epoch", "second", "millisecond", "microsecond", "minute", "hour", "day", "month", "quarter", "year", "decade", "century", "millennium", "dow", "isodow", "doy", "week")


@entry("dt_extract_all", "select event_id, " + ", ".join(f"cast(floor(date_part('{p}', ts)) as bigint) as p_{p}" for p in _PARTS) + " from events")
def dt_extract_all(spark: SparkSession, d: str) -> DataFrame:
    """All date parts."""
    return table(spark, d, "events").select("event_id", *[C.date_part(p, "ts").alias(f"p_{p}") for p in _PARTS])


@entry("bucket_counts", "select time_bucket(interval '1 hour', ts) as bucket, event_type, count(*) as n, round(sum(value), 2) as s from events group by all")
def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(C.time_bucket(3600 * 10**6, "ts").alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s"))


@entry("stream_bucket_counts", "select time_bucket(interval '1 hour', ts) as bucket, event_type, count(*) as n from events group by all")
def stream_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same buckets as a stream, run to its end."""
    return stream_buckets(spark, d)


@entry("range_join_tiers", "with tiers(tier, least) as (values (1, 0.0), (2, 50000.0), (3, 150000.0), (4, 250000.0)) select o_orderkey, tier from orders join tiers on o_totalprice >= least")
def range_join_tiers(spark: SparkSession, d: str) -> DataFrame:
    tiers = files.values(spark, [(1, 0.0), (2, 50000.0), (3, 150000.0), (4, 250000.0)], "tier int, least double")
    return range_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), tiers, "o_totalprice", ">=", "least").select("o_orderkey", "tier")


@entry("range_join_times", "select s_suppkey, c_custkey from supplier join customer on s_acctbal < c_acctbal")
def range_join_times(spark: SparkSession, d: str) -> DataFrame:
    right = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return range_join(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), right, "s_acctbal", "<", "c_acctbal").select("s_suppkey", "c_custkey")


@entry("mark_join", "select p_partkey, p_size in (select nullif(l_linenumber, 3) from lineitem) as mark from part")
def mark(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "lineitem").select(F.expr("nullif(l_linenumber, 3)").alias("k"))
    return mark_join(table(spark, d, "part").select("p_partkey", "p_size"), keys, "p_size", "k").select("p_partkey", "mark")


@entry("series_range", "select range from range(5, 100, 7)")
def series_range(spark: SparkSession, d: str) -> DataFrame:
    return files.series(spark, 5, 100, 7)


@entry("series_inclusive", "select generate_series from generate_series(10, -10, -5)")
def series_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return files.generate_series(spark, 10, -10, -5)


@entry("read_parquet_glob", "select r_regionkey, r_name from region")
def read_parquet_glob(spark: SparkSession, d: str) -> DataFrame:
    return files.read_parquet(spark, f"{d}/regio*.parquet")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@entry("insert_roundtrip", "select o_orderkey, o_custkey, o_orderpriority, cast(null as double) as note from orders")
def insert_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A partitioned, sorted table; two inserts of all orders into some of its columns."""
    store = Store(spark, _scratch(spark))
    store.create_table("t", "o_orderkey long, o_custkey long, o_orderpriority string, note double", partition_by=["o_orderpriority"], sort_by=["o_orderkey"])
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    store.insert("t", orders.where("o_orderkey % 2 <=> 0"), ["o_orderkey", "o_custkey", "o_orderpriority"])
    store.insert("t", orders.where("not (o_orderkey % 2 <=> 0)"), by_name=True)
    return store.read("t")


@entry("compact_roundtrip", "select o_orderkey, o_orderpriority from orders")
def compact_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Three inserts with overlapping ranges, compacted and vacuumed."""
    store = Store(spark, _scratch(spark))
    store.create_table("t", "o_orderkey long, o_orderpriority string", partition_by=["o_orderpriority"], sort_by=["o_orderkey"])
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    for k in range(3):
        store.insert("t", orders.where(F.col("o_orderkey") % 3 == k))
    store.compact("t", final=True)
    store.vacuum("t", data_retention_s=0)
    return store.read("t")


@entry("adopted_parquet", "select n_nationkey, n_name, n_regionkey from nation")
def adopted_parquet(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, _scratch(spark))
    store.create_table("geo.nation", table(spark, d, "nation").schema, with_pre_existing_parquets=f"{d}/nation.parquet")
    return store.read("geo.nation")


@entry("copy_text", "select * from (values (1, 'plain'), (2, 'tab' || chr(9) || 'inside'), (3, null), (4, 'back\\slash'), (5, 'A' || chr(10))) as t(id, s)")
def copy_text(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    lines = ["1\tplain", "2\ttab\\tinside", "3\t\\N", "4\tback\\\\slash", "5\t\\x41\\n", "\\.", "6\tnot read"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return files.copy_text(spark, path, "id int, s string")


@entry("copy_arrow", "select * from (values (cast(1 as bigint), 'a'), (2, 'b')) as t(id, s)")
def copy_arrow(spark: SparkSession, d: str) -> DataFrame:
    out = io.BytesIO()
    batch = pa.table({"x": pa.array([1, 2], pa.int32()), "y": ["a", "b"]})
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_table(batch)
    return files.copy_arrow(spark, out.getvalue(), "id long, s string")


@entry("system_tables", "select * from (values ('geo', 'nation', 0, 'n_nationkey', 'int'), ('geo', 'nation', 1, 'n_name', 'string')) as t(schema_name, table_name, position, column_name, data_type)")
def system_tables(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, _scratch(spark))
    store.create_table("geo.nation", "n_nationkey int, n_name string")
    return store.system_table("columns")


@entry("explain_plan")
def explain_plan(spark: SparkSession, d: str) -> DataFrame:
    """EXPLAIN: a row for each line of the plan's text."""
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    text = spark.sql("explain formatted select l_returnflag, count(*) from lineitem where l_quantity > 40 group by l_returnflag").first()[0]
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"))], "line int, text string")


@entry("now_statement", "select cast(1 as bigint) as instants")
def now_statement(spark: SparkSession, d: str) -> DataFrame:
    """now() is one instant for a statement."""
    return spark.range(1000).select(F.current_timestamp().alias("now")).distinct().selectExpr("count(*) as instants")


def drop_caches(spark: SparkSession) -> int:
    """Drops what Spark has cached; how many cached tables or RDDs that were."""
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    spark.catalog.clearCache()
    for rdd in list(spark.sparkContext._jsc.getPersistentRDDs().values()):
        rdd.unpersist(True)
    return held - spark.sparkContext._jsc.getPersistentRDDs().size()


@entry("drop_cache", "select cast(1 as bigint) as evicted")
def drop_cache(spark: SparkSession, d: str) -> DataFrame:
    """Drops the one table that is cached."""
    drop_caches(spark)
    table(spark, d, "region").cache().count()
    return spark.createDataFrame([(drop_caches(spark),)], "evicted long")


@entry("set_reset", "select * from (values ('before', null), ('set', 'true'), ('reset', null)) as t(step, value)")
def set_reset(spark: SparkSession, d: str) -> DataFrame:
    """SET and RESET of a setting."""
    key, seen = f"tidemill.stats.{uuid.uuid4().hex}", []
    for step, statement in (("before", None), ("set", f"set {key} = true"), ("reset", f"reset {key}")):
        if statement:
            spark.sql(statement)
        seen.append((step, spark.conf.get(key, None)))
    return spark.createDataFrame(seen, "step string, value string")


@entry("late_top", "select * from events where event_type = 'click' order by value desc nulls last, event_id limit 10")
def late_top_events(spark: SparkSession, d: str) -> DataFrame:
    """A top-n of whole rows whose other columns are read for those rows only."""
    return late_top(spark, f"{d}/events.parquet", [C.desc("value"), C.asc("event_id")], 10, F.col("event_type") == "click")


_CODECS = ("none", "snappy", "gzip", "zstd", "lz4_raw")


@entry("codec_roundtrip", "select codec, n_nationkey, n_name from nation cross join (values " + ", ".join(f"('{c}')" for c in _CODECS) + ") as c(codec)")
def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A table written with every codec and read again."""
    path, out = _scratch(spark), None
    for codec in _CODECS:
        table(spark, d, "nation").write.option("compression", codec).parquet(f"{path}/{codec}")
        part = files.read_parquet(spark, f"{path}/{codec}/*.parquet").select(F.lit(codec).alias("codec"), "n_nationkey", "n_name")
        out = part if out is None else out.unionByName(part)
    return out


@entry("variant_roundtrip", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def variant_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """JSON text as VARIANT, written (shredded, where the session asks for it) and read again."""
    path = _scratch(spark)
    table(spark, d, "events").select("event_id", F.parse_json("props").alias("j")).write.parquet(path)
    return spark.read.parquet(path).select("event_id", F.variant_get("j", "$.k", "bigint").alias("k"))
