"""URL lists, vectors, components, the registry and the pipeline."""

from datetime import date, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import rows
from tidemill.llm import common, components, permutation, registry, urllists
from tidemill.tables import table

# URL filters


def judged(log, url, day):
    """The rule in plain Python: (blocked, list, pattern)."""
    m = urllists_host(url)
    if m is None:
        return False, None, None
    host, path = m
    active = set()
    for key in {r[:3] for r in log}:
        state = "remove"
        for d in sorted({r[4] for r in log if r[:3] == key}):
            if d <= day:
                state = "remove" if any(r[3] == "remove" for r in log if r[:3] == key and r[4] == d) else "add"
        if state == "add":
            active.add(key)
    hits = [(-len(p), v == "block", name, p) for name, p, v in active if host == p or host.endswith("." + p) or ("/" in p and (f"{host}/{path}" + "/").startswith(p + "/"))]
    if not hits:
        return False, None, None
    _, blocked, name, pattern = min(hits)
    return blocked, name, pattern


def urllists_host(url):
    import re

    m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::\d+)?(?:/([^?#]*))?", url or "", re.I)
    return (m[1].lower().rstrip("."), (m[2] or "").strip("/")) if m else None


URLS = ["https://a.b.com/x/y", "http://B.com.", "https://user:pw@c.a.b.com:80/x?q=1#f", None, "", "not a url", "https://b.com/x", "https://b.com/xy", "ftp://other.org/"]
LOG = [("l", "b.com", "block", "add", "2023-01-10"), ("l", "b.com", "block", "remove", "2023-02-10"), ("l", "b.com", "block", "add", "2023-02-20"), ("m", "a.b.com", "allow", "add", "2023-01-15"), ("m", "a.b.com", "block", "add", "2023-02-25"), ("n", "b.com/x", "allow", "add", "2023-01-12"), ("n", "other.org", "block", "remove", "2023-01-01"), ("n", "b.com", "allow", "add", "2023-03-01"), ("l", "c.a.b.com", "block", "add", "2023-01-20"), ("l", "c.a.b.com", "block", "remove", "2023-01-20")]


def test_urls_equal_brute_force(spark):
    days = [date(2023, 1, 1) + timedelta(days=k) for k in range(0, 70, 3)]
    captures = spark.createDataFrame([(u, d) for u in URLS for d in days for _ in range(2)], "url string, fetched date").withColumn("list", F.lit("clash"))
    got = urllists.judge(captures, urllists.intervals(urllists.log_frame(spark, LOG))).collect()
    assert len(got) == 2 * len(URLS) * len(days)
    for r in got:
        assert (r.blocked, r["list"], r["pattern"]) == judged(LOG, r.url, str(r.fetched)), (r.url, r.fetched)


def test_null_times_null_entries_and_long_paths(spark):
    long = "https://b.com/" + "x/" * 20_000
    rows_ = [("https://b.com/x", None), (long, date(2023, 1, 20)), ("https://z.com/" + "y/" * 20_000, date(2023, 1, 20))]
    captures = spark.createDataFrame(rows_, "url string, fetched date")
    odd = [*LOG, ("n", "b.com/x/x", "block", "add", "2023-01-13")]
    log = urllists.log_frame(spark, odd).unionByName(spark.sql("select null as list, 'b.com' as pattern, 'block' as verdict, 'add' as action, date'2022-01-01' as day"))
    got = {r.url: r for r in urllists.judge(captures, urllists.intervals(log)).collect()}
    assert (got["https://b.com/x"].blocked, got["https://b.com/x"].pattern) == (False, None)
    assert (got[long].blocked, got[long].pattern) == (True, "b.com/x/x") and not got[rows_[2][0]].blocked


def test_empty_log_or_table(spark):
    captures = spark.createDataFrame([("https://b.com", date(2023, 5, 5))], "url string, fetched date")
    assert not urllists.judge(captures, urllists.intervals(urllists.log_frame(spark, []))).first().blocked
    assert urllists.judge(captures.where("false"), urllists.intervals(urllists.log_frame(spark, LOG))).count() == 0


# vectors


def brute(rows_, queries, k):
    ids, x = np.array([i for i, _ in rows_]), np.array([v for _, v in rows_], float)
    out = {}
    for qid, q in queries:
        d = np.sqrt(((x - np.array(q)) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != qid][:k]
        out[qid] = [(int(ids[i]), d[i]) for i in order]
    return out


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.9), ("sf0.1", 0.9), ("check_s", 0.9)])
def test_recall_of_the_index(spark, sf, least):
    d = f"/root/testdata/{sf}"
    if not Path(d).is_dir():
        pytest.skip(f"{d} isn't here")
    found = permutation.op10_permutation_ann(spark, d).toPandas()
    usable = [(r.vec_id, r.v) for r in permutation.usable(table(spark, d, "embeddings")).collect()]
    exact = brute(usable, [(i, v) for i, v in usable if i % 100 == 0], 10)
    assert set(found.query_id) == set(exact) and (found.groupby("query_id").size() == 10).all()
    hits = sum(len(set(found[found.query_id == q].vec_id) & {i for i, _ in near}) for q, near in exact.items())
    assert hits / sum(map(len, exact.values())) >= least
    x = dict(usable)
    for r in found.sample(50, random_state=0).itertuples():
        assert r.score == pytest.approx(float(np.sqrt(((np.array(x[r.query_id]) - np.array(x[r.vec_id])) ** 2).sum())), abs=1e-12)


def test_vectors_odd_inputs(spark):
    good = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(3, [3.0, 1.0, 0.0])]
    bad = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 1.0, 1.0]), (105, [1.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([*good, *bad], "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    usable = permutation.usable(frame)
    got = permutation.search(usable, usable.where("vec_id % 20 = 0"), 5, anchors=8, posted=3, opened=9, shard_rows=10, whole_rows=10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, permutation.search(usable, usable.where("vec_id % 20 = 0"), 5).collect()))
    exact = brute(good, [(i, v) for i, v in good if i % 20 == 0], 5)
    for q, near in exact.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [s for *_, s in mine] == pytest.approx([s for _, s in near])
        assert [i for _, i, _ in mine] == [i for i, _ in near]
    assert permutation.search(usable.where("false"), usable.where("false")).count() == 0
    twins = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])], "vec_id long, v array<double>")
    ranked = sorted((r.rank, r.vec_id) for r in permutation.search(twins, twins.where("vec_id = 0"), 1).collect())
    assert ranked == [(1, 1), (1, 2), (1, 2)]
    few = usable.where("vec_id in (0, 1)")
    assert permutation.search(few, few.where("vec_id = 0"), 10).count() == 1


# components


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 240)]
    root = {n: n for e in edges for n in e}
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    alone = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.component for r in got.collect()} == {n: r for n, r in root.items() if n not in alone}


def chains_and_stars(rng):
    """Edges whose components no single step finds, and the least node of each."""
    order = rng.permutation(900).tolist()
    edges = [*zip(order[:300], order[1:301], strict=True), *((order[400], k) for k in order[401:600]), *zip(order[600:900:2], order[601:900:2], strict=True), (order[7], order[7])]
    least = {k: min(g) for g in (order[:301], order[400:600], *(order[k : k + 2] for k in range(600, 900, 2))) for k in g}
    return edges, least


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_at_once_equal_those_by_rounds(spark, kind):
    edges, least = chains_and_stars(np.random.default_rng(3))
    name = (lambda k: k) if kind == "long" else (lambda k: (k * 12345 % 65536).to_bytes(2, "big"))
    groups = {}
    for k, m in least.items():
        groups.setdefault(m, []).append(name(k))
    want = {k: min(g) for g in groups.values() for k in g}
    table = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}")
    for within in (components.WITHIN, 0):
        assert {_plain(r.node): _plain(r.component) for r in components.components(table, within).collect()} == want
    assert components.components(table.where("false")).collect() == []


def _plain(v):
    return bytes(v) if isinstance(v, bytearray) else v


def test_components_that_fit_a_task_take_few_of_them(spark):
    """Each round of steps was thousands of tasks on many partitions, of which the driver keeps notes."""
    tracker, group = spark.sparkContext.statusTracker(), "few-tasks"
    edges, least = chains_and_stars(np.random.default_rng(4))
    table = common.stash(spark.createDataFrame(edges, "a long, b long"))
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert components.components(table).count() == len(least)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) <= 8


# registry and pipeline


def test_each_operator_is_registered():
    names = registry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_url_filters_equal_sql(spark, medium):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{medium}/pages.parquet'")
    got = registry.queries()["op9_url_filters"](spark, medium).toPandas()
    assert rows(got) == rows(con.execute(registry.oracle_sql()["op9_url_filters"]).fetchdf())


def test_native_operator_runs_no_python(spark, small):
    plan = registry.queries()["op9_url_filters"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_stash_survives_and_discard_removes(spark):
    df = common.stash(spark.range(5))
    assert df.count() == 5
    common.discard(df)
    with pytest.raises(Exception):
        df.collect()


def test_pipeline_stages(spark, small):
    import corpus_pipeline as pipeline

    from tidemill.llm import pieces, toxicity
    from test_documents import exact_components

    docs = table(spark, small, "documents")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "sentencepiece_encoding"]
    kept = []
    for _, stage in pipeline.STAGES:
        docs = common.stash(stage(spark, docs, small))
        kept.append({r.doc_id: r for r in docs.collect()})
        assert len(kept[-1]) == docs.count()
    everything = {r.doc_id: r for r in table(spark, small, "documents").collect()}
    model = toxicity.fit(spark, table(spark, small, "documents"), table(spark, small, "labels"))
    ids = sorted(everything)
    scores = dict(zip(ids, model.score([everything[i].text for i in ids]), strict=True))
    assert set(kept[0]) == {i for i in ids if scores[i] < toxicity.THRESHOLD}
    component, _ = exact_components([(i, kept[0][i].text) for i in sorted(kept[0])], 5, 80)
    assert set(kept[1]) == {i for i, c in component.items() if i == c}
    items = [" ".join(r.text.split()) for r in table(spark, small, "benchmark").collect()]
    assert not any(t in " ".join((r.text or "").split()) for r in kept[2].values() for t in items)
    assert set(kept[3]) == set(kept[2]) == set(kept[4])
    assert not any('token = "' in (r.text or "") and 'token = "<secret>"' not in r.text for r in kept[3].values())
    assert all(r.n_chars == len(r.text) for r in kept[3].values() if r.text is not None)
    coder = pieces.Coder(pieces.Vocabulary.load(pieces.MODEL))
    assert all(coder.decode(r.ids) == r.text for r in kept[4].values())
    assert sorted(map(str, pipeline.run(spark, small).collect())) == sorted(map(str, kept[4].values()))


def test_pipeline_odd_inputs(spark, small):
    import corpus_pipeline as pipeline

    from test_documents import ODD, SCHEMA

    docs = spark.createDataFrame(ODD, SCHEMA)
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.where("text is null").count() == 1, name
        assert stage(spark, docs.where("false"), small).count() == 0, name
