"""Every catalogue query against DuckDB on the smallest tables."""

import duckdb
import pytest

from compare import rows
from tidemill.plans import registry
from tidemill.tables import TABLES

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
WITHOUT = {"explain_plan"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def test_every_query_has_sql_but_the_volatile_ones():
    assert set(QUERIES) - set(ORACLES) == WITHOUT


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck, small):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(WITHOUT))
def test_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_late_top_reads_other_columns_of_few_rows(spark, small):
    from pyspark.sql import functions as F

    from tidemill.operators.late import late_top

    path = f"{small}/events.parquet"
    got = late_top(spark, path, [F.desc("ts"), F.asc("event_id")], 7, F.col("event_type") == "view")
    want = spark.read.parquet(path).where("event_type = 'view'").orderBy(F.desc("ts"), "event_id").limit(7)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert late_top(spark, path, [F.desc("ts")], 7, F.col("event_id") < 0).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "select cast('x1' as int)",
        "select (select r_name from region)",
        "select parse_json('{a')",
        "select variant_get(parse_json('{\"a\": \"x\"}'), '$.a', 'int')",
        "select cast(9223372036854775807 as bigint) + cast(r_regionkey + 1 as bigint) from region",
        "select 1 / (r_regionkey - r_regionkey) from region",
        "select r_name from region group by r_regionkey",
        "select nothing from region",
    ],
)
def test_bad_statements_fail(spark, small, text):
    from tidemill.tables import views

    with pytest.raises(Exception):
        views(spark, small, "region").sql(text).collect()


def test_cte_used_twice_is_run_once(spark, small):
    query = QUERIES["nested_ctes"](spark, small)
    query.collect()
    assert "ReusedExchange" in query._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_filter_and_columns_reach_the_scan(spark, small):
    query = QUERIES["tpch_q6"](spark, small)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(query._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_orderkey" not in plan


def test_top_n_is_one_operator(spark, small):
    assert "TakeOrderedAndProject" in QUERIES["cb_group_topn"](spark, small)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "whole"),
    [
        ("range_join_times", "select count(*) from supplier, customer where s_acctbal < c_acctbal"),
        ("insert_roundtrip", "select count(*) from orders"),
        ("join_null_keys", "select count(*) from orders"),
        ("sort_nulls", "select count(*) from events"),
        ("sort_nulls_first", "select count(*) from events"),
    ],
)
def test_reads_whole_tables(name, whole, spark, duck, small):
    assert QUERIES[name](spark, small).count() == duck.execute(whole).fetchone()[0]


def test_orders_are_not_shuffled_to_tiers(spark, small):
    """Four tiers are sent to the orders; dealt by tier, all orders would lie in four tasks."""
    query = QUERIES["range_join_tiers"](spark, small)
    query.collect()
    above, _, below = query._jdf.queryExecution().executedPlan().toString().partition("BroadcastNestedLoopJoin")
    orders = below.partition("BroadcastExchange")[0]
    assert "o_totalprice" in orders and "Exchange" not in above + orders


@pytest.mark.parametrize("name", ["sort_nulls", "sort_nulls_first"])
def test_nulls_and_values_in_order(name, spark, duck, small):
    got = [tuple(r) for r in QUERIES[name](spark, small).collect()]
    assert got == duck.execute(ORACLES[name]).fetchall()
    assert len({t is None for _, t in got}) == 2
