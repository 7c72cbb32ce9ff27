import io

import pyarrow as pa
import pytest

from tidemill.operators import joins
from tidemill.operators.joins import mark_join, range_join
from tidemill.sources import files
from tidemill.sources.store import Store


def test_glob_needs_a_match_and_one_schema(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_parquet(spark, f"{tmp_path}/none*.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/a1")
    spark.range(2).write.parquet(f"{tmp_path}/a2")
    assert files.read_parquet(spark, f"{tmp_path}/a*").count() == 5
    spark.range(1).selectExpr("id as other").write.parquet(f"{tmp_path}/a3")
    with pytest.raises(ValueError):
        files.read_parquet(spark, f"{tmp_path}/a*")


def test_series(spark):
    assert [r[0] for r in files.series(spark, 3).collect()] == [0, 1, 2]
    assert [r[0] for r in files.generate_series(spark, 3, 9, 3).collect()] == [3, 6, 9]
    assert files.generate_series(spark, 5, 1).count() == 0
    for f in (files.series, files.generate_series):
        with pytest.raises(ValueError):
            f(spark, 0, 5, 0)


def test_copy_text(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("1\ta\\tb\\\\n\n2\t\\N\n3\t\\101\\x42c\\d\n\\.\n9\tafter\n")
    got = files.copy_text(spark, f"file://{path}", "id int, s string").collect()
    assert [tuple(r) for r in got] == [(1, "a\tb\\n"), (2, None), (3, "ABcd")]
    path.write_text("1\ta\n2\n")
    with pytest.raises(Exception, match="expected 2 columns, found 1"):
        files.copy_text(spark, f"file://{path}", "id int, s string").collect()


def test_copy_text_keeps_every_character(spark, tmp_path):
    path = tmp_path / "odd.txt"
    path.write_text("1\t\ue000 and \ue001\n2\tends in \\\\\n3\t\\\tx\\N\n4\t\\\\N\n", encoding="utf-8")
    got = [tuple(r) for r in files.copy_text(spark, f"file://{path}", "id int, s string").collect()]
    assert got == [(1, "\ue000 and \ue001"), (2, "ends in \\"), (3, "\txN"), (4, "\\N")]
    path.write_text("1|a\\|b|c\n")
    assert [tuple(r) for r in files.copy_text(spark, f"file://{path}", "id int, s string, t string", delimiter="|").collect()] == [(1, "a|b", "c")]
    folder = tmp_path / "several"
    folder.mkdir()
    for name in "ab":
        (folder / f"{name}.txt").write_text("1\ta\n")
    with pytest.raises(ValueError, match="several files"):
        files.copy_text(spark, f"file://{folder}", "id int, s string")


def test_joins_keep_columns_named_like_their_own(spark):
    left = spark.sql("select id as a, cast(id as double) as x, 1 as _bin, 2 as _own, 3 as _key, 4 as _n from range(5)")
    right = spark.sql("select id as b, cast(id as double) as y, 5 as __bin from range(5)")
    got = range_join(left, right, "x", "<", "y", 4)
    assert got.columns == [*left.columns, *right.columns] and got.count() == 10
    marked = mark_join(left, right, "a", "b")
    assert marked.columns == [*left.columns, "mark"] and marked.where("mark and _key = 3").count() == 5


def test_system_tables_have_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/root")
    store.create_schema("s")
    store.create_table("s.t", "k long")
    store.insert("s.t", spark.range(3))
    assert store.system_table("datastores").count() == 1
    assert [(r.schema_name, r.table_name, r.version) for r in store.system_table("tables").collect()] == [("s", "t", 1)]
    files_ = store.system_table("table_files").collect()
    assert files_ and all(r.bytes > 0 for r in files_)
    with pytest.raises(LookupError):
        store.system_table("users")


def test_two_writers_of_one_version(spark, tmp_path):
    """Both read version 0; one commits, the other is refused and its rows are not seen."""
    first, second = Store(spark, f"file://{tmp_path}/root"), Store(spark, f"file://{tmp_path}/root")
    first.create_table("t", "k long")
    stale = second.manifest("t")
    second.manifest = lambda table: stale
    first.insert("t", spark.range(2))
    with pytest.raises(RuntimeError, match="changed by someone else"):
        second.insert("t", spark.range(100, 105))
    assert sorted(r.k for r in first.read("t").collect()) == [0, 1]


def test_copy_arrow_is_positional_and_checks_width(spark):
    out = io.BytesIO()
    t = pa.table({"whatever": pa.array([1, None], pa.int16())})
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    assert [tuple(r) for r in files.copy_arrow(spark, out.getvalue(), "id long").collect()] == [(1,), (None,)]
    with pytest.raises(ValueError):
        files.copy_arrow(spark, out.getvalue(), "id long, b long")


def test_store_life_cycle(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/root")
    store.create_table("s.t", "k long, g string, v double", partition_by=["g"], sort_by=["k"])
    assert store.read("s.t").count() == 0
    rows = spark.range(100).selectExpr("id as k", "if(id % 2 = 0, 'a b', null) as g")
    assert store.insert("s.t", rows.where("k % 3 = 0"), ["k", "g"]) == 34
    assert store.insert("s.t", rows.where("k % 3 = 1"), by_name=True) == 33
    assert store.insert("s.t", rows.where("k % 3 = 2").selectExpr("k", "g", "1.5D as v")) == 33
    before = sorted(map(str, store.read("s.t").collect()))
    n = store.system_table("table_files").count()
    assert store.compact("s.t", final=True) == n
    assert sorted(map(str, store.read("s.t").collect())) == before
    assert store.system_table("table_files").count() < n
    assert store.vacuum("s.t", data_retention_s=3600) == 0
    assert store.vacuum("s.t", data_retention_s=0) >= n
    assert sorted(map(str, store.read("s.t").collect())) == before
    assert [r["column_name"] for r in store.system_table("columns").collect()] == ["k", "g", "v"]
    assert store.system_table("tables").first()["version"] == 4
    store.drop_table("s.t")
    with pytest.raises(LookupError):
        store.read("s.t")


def test_store_refusals(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/root")
    with pytest.raises(ValueError):
        store.create_table("t", "k long", primary_key=["k"])
    with pytest.raises(ValueError):
        store.create_table("t", "k long", sort_by=["x"])
    store.create_table("t", "k long")
    with pytest.raises(ValueError):
        store.create_table("t", "k long")
    with pytest.raises(ValueError):
        store.insert("t", spark.range(1).selectExpr("id", "id as b"))
    old = store.manifest("t")
    store.insert("t", spark.range(1))
    with pytest.raises(RuntimeError):
        store._commit("t", old, files=[])


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
@pytest.mark.parametrize("bins", [1, 4, 64])
def test_range_join(spark, op, bins):
    left = spark.sql("select id as a, nullif(cast(id * 7 % 23 as double), 5) as x from range(40)")
    right = spark.sql("select id as b, nullif(cast(id * 5 % 23 as double), 7) as y from range(30)")
    want = {(l.a, r.b) for l in left.collect() for r in right.collect() if l.x is not None and r.y is not None and eval(f"{l.x}{op}{r.y}")}
    got = [(r.a, r.b) for r in range_join(left, right, "x", op, "y", bins).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("values", [0, 1 << 20])
@pytest.mark.parametrize("op", ["<", ">="])
@pytest.mark.parametrize("sizes", [(50, 7), (7, 50)])
def test_range_join_of_either_size(spark, monkeypatch, sizes, op, values):
    """The smaller side is packed and broadcast, or meets the other part by part; keys repeat, and NaN is the largest."""
    monkeypatch.setattr(joins, "BROADCAST_VALUES", values)
    left, right = (spark.sql(f"select id as {a}, if(id = 3, double('nan'), cast(id % 5 as double)) as {x} from range({n})") for n, a, x in zip(sizes, "ab", "xy", strict=True))
    left.createOrReplaceTempView("range_left")
    right.createOrReplaceTempView("range_right")
    want = [tuple(r) for r in spark.sql(f"select * from range_left join range_right on x {op} y").collect()]
    joined = range_join(left, right, "x", op, "y", 4)
    assert sorted(map(str, joined.collect())) == sorted(f"Row(a={a}, x={x}, b={b}, y={y})" for a, x, b, y in want)
    assert ("CartesianProduct" in joined._jdf.queryExecution().executedPlan().toString()) == (not values)


def test_range_join_makes_rows_after_the_join(spark):
    """Rows are made out of blocks that have met, not before: neither a broadcast nor a shuffle carries a row once for each bin that it reaches."""
    left, right = spark.sql("select id as a, cast(id as double) as x from range(2000)"), spark.sql("select id as b, cast(id as double) as y from range(3000)")
    joined = range_join(left, right, "x", "<", "y")
    assert joined.count() == sum(2999 - x for x in range(2000))
    above, generate, _ = joined._jdf.queryExecution().optimizedPlan().toString().partition("Generate explode")
    assert generate and "Join" not in above


def test_range_join_of_nothing(spark):
    empty = spark.sql("select 1 as b, 1.0D as y where false")
    assert range_join(spark.sql("select 1 as a, 1.0D as x"), empty, "x", "<", "y").count() == 0


def test_mark_join_is_three_valued(spark):
    left = files.values(spark, [(1,), (2,), (None,)], "a int")
    mark = lambda rows: {r.a: r.mark for r in mark_join(left, files.values(spark, rows, "k int"), "a", "k").collect()}
    assert mark([(1,), (1,)]) == {1: True, 2: False, None: None}
    assert mark([(1,), (None,)]) == {1: True, 2: None, None: None}
    assert mark([]) == {1: False, 2: False, None: False}
