"""Delta logs written by hand, as the protocol has them."""

import json

import pytest

from tidemill.sources.delta import read_delta

SCHEMA = json.dumps({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("id", "long"), ("day", "date"), ("note", "string"))]})


def commit(root, version, *actions):
    log = root / "_delta_log"
    log.mkdir(exist_ok=True)
    (log / f"{version:020d}.json").write_text("\n".join(json.dumps(a) for a in actions) + "\n")


def data(spark, root, name, low, high):
    """One file of ids and notes; its path in the log."""
    out = root / name
    spark.range(low, high).selectExpr("id", "concat('n', id) as note").coalesce(1).write.parquet(f"file://{out}")
    return f"{name}/{next(p.name for p in out.iterdir() if p.suffix == '.parquet')}"


def add(path, **values):
    return {"add": {"path": path.replace(" ", "%20"), "partitionValues": values, "size": 1, "modificationTime": 0, "dataChange": True}}


START = ({"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {"id": "x", "schemaString": SCHEMA, "partitionColumns": ["day"], "configuration": {}, "format": {"provider": "parquet"}}})


def ids(frame):
    return sorted(r.id for r in frame.collect())


@pytest.fixture
def delta(spark, tmp_path):
    root = tmp_path / "some table"
    root.mkdir()
    a, b, c = data(spark, root, "day=2024-01-01", 0, 3), data(spark, root, "odd name", 10, 12), data(spark, root, "x", 20, 21)
    commit(root, 0, *START, add(a, day="2024-01-01"), add(b, day=None))
    commit(root, 1, {"remove": {"path": a, "deletionTimestamp": 1, "dataChange": True}}, add(c, day="2024-02-02"))
    commit(root, 2, add(a, day="2024-01-01"))
    return root, a


def test_versions(spark, delta):
    root, _ = delta
    path = f"file://{root}"
    assert ids(read_delta(spark, path)) == [0, 1, 2, 10, 11, 20]
    assert ids(read_delta(spark, path, 1)) == [10, 11, 20]
    assert ids(read_delta(spark, path, 0)) == [0, 1, 2, 10, 11]
    got = {r.id: (str(r.day), r.note) for r in read_delta(spark, path).collect()}
    assert got[1] == ("2024-01-01", "n1") and got[10] == ("None", "n10") and got[20] == ("2024-02-02", "n20")
    assert read_delta(spark, path).columns == ["id", "day", "note"]
    with pytest.raises(LookupError):
        read_delta(spark, path, 9)
    with pytest.raises(FileNotFoundError):
        read_delta(spark, f"{path}/_delta_log")


def test_checkpoint_stands_for_the_commits_before(spark, delta):
    root, a = delta
    log = root / "_delta_log"
    lines = [json.loads(x) for v in (0, 1) for x in (log / f"{v:020d}.json").read_text().splitlines()]
    kept = [x for x in lines if "remove" not in x and x.get("add", {}).get("path") != a]
    (root / "c.json").write_text("\n".join(map(json.dumps, kept)))
    schema = "add struct<path: string, partitionValues: map<string, string>, size: long>, metaData struct<schemaString: string, partitionColumns: array<string>, configuration: map<string, string>>, protocol struct<minReaderVersion: int>"
    spark.read.schema(schema).json(f"file://{root}/c.json").coalesce(1).write.parquet(f"file://{root}/c")
    next(p for p in (root / "c").iterdir() if p.suffix == ".parquet").rename(log / f"{1:020d}.checkpoint.parquet")
    (log / f"{0:020d}.json").unlink()
    assert ids(read_delta(spark, f"file://{root}")) == [0, 1, 2, 10, 11, 20]
    assert ids(read_delta(spark, f"file://{root}", 1)) == [10, 11, 20]
    with pytest.raises(LookupError):
        read_delta(spark, f"file://{root}", 0)


@pytest.mark.parametrize(
    "action",
    [
        {"protocol": {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["somethingNew"]}},
        {"metaData": {**START[1]["metaData"], "configuration": {"delta.columnMapping.mode": "name"}}},
        {"add": {"path": "x", "partitionValues": {}, "deletionVector": {"storageType": "u", "pathOrInlineDv": "a", "sizeInBytes": 1, "cardinality": 1}}},
    ],
)
def test_what_it_does_not_know_is_refused(spark, delta, action):
    root, _ = delta
    commit(root, 3, action)
    with pytest.raises(NotImplementedError):
        read_delta(spark, f"file://{root}")


def test_empty_table(spark, tmp_path):
    commit(tmp_path, 0, *START)
    assert read_delta(spark, f"file://{tmp_path}").count() == 0
