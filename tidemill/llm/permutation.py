"""Approximate nearest neighbours by a permutation index.

Anchors (the method's reference points) are a bounded sample of the rows, as many as the root of their number. A vector is
represented by all anchors in order of nearness and posted in the inverted files of its ``posted`` nearest; a query opens the
files of its own nearest ``opened``. In a file, vectors are ranked by Spearman's footrule between their order of anchors and
the query's; the best of all files together, ``budget * sqrt(rows)`` at most by expectation, are reranked by exact distance in double
precision, and the nearest are merged. Files are apart, so a query brings along the footrule that so many of a bounded sample of rows stay
within; in the file of its nearest anchor ``k + 1`` vectors are reranked at least.

A pair that shares several files is looked at only in the first of the query's, and a file is dealt over as many
shards as ``shard_rows`` asks for, so neither a favourite anchor nor one vector repeated in a third of
the rows makes a large task: equal vectors of a shard are one entry and only their smallest ids, as many as can be
answers, are listed. Rows sent are ``posted`` a vector and ``opened`` a query (times the shards of a file, in blocks of queries).

Cases: vectors that are null, of another length than the most common one, zero, or hold a null or non-finite
component take no part. Fewer candidates than ``k`` are all returned, as far as they share a file with the query; tables of at most
``whole_rows`` rows are one file. Ties go to the smaller id. A row whose id occurs more than once is a query of its own each time,
with ranks of its own; a query's own id is never its answer. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import prepare
from tidemill.tables import table

ANCHORS = 256  # at least; the root of the number of rows beyond
MOST_ANCHORS = 32_768  # their order is two bytes each in a posting
POSTED = 4
OPENED = 5  # times the root of the number of anchors
BUDGET = 4  # times the root of the number of rows
SAMPLE_ROWS = 4096
SAMPLE_BYTES = 32 << 20
WHOLE_ROWS = 256
SHARD_ROWS = 20_000
QUERY_ROWS = 50_000


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the vector in double precision, of rows that can take part."""
    v = F.col(embedding).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & good)


def chosen_rows(vectors: DataFrame, number: int) -> np.ndarray:
    """The rows that come first by a hash of the vector: ``number`` different ones at most."""
    hashed = vectors.select("v", F.xxhash64("v").alias("h"))
    least = hashed.select("h").distinct().orderBy("h").limit(number)
    some = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.min("v").alias("v"))  # ``number`` of them
    return np.array([r.v for r in some.orderBy("h").collect()], np.float64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def places(x: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """For each row, the place of every anchor in its order of nearness."""
    d = (anchors**2).sum(1)[None] - 2 * x @ anchors.T
    order = np.argsort(d, axis=1, kind="stable")
    out = np.empty(order.shape, np.uint16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.uint16)[None], 1)
    return out


def _footrule(places_: np.ndarray, place: np.ndarray) -> np.ndarray:
    small = np.int16 if len(place) < 1 << 15 else np.int32
    return np.abs(places_.astype(small, copy=False) - place.astype(small)).sum(1, dtype=np.int64)


def post(vectors: DataFrame, anchors: np.ndarray, files: int, sample: np.ndarray | None = None, share: float = 0.0) -> DataFrame:
    """One row for each vector and each of its first ``files`` anchors: file, row_id, vec_id, v, place (bytes) and the footrule within which that share of the sample lies."""
    spark = prepare(vectors.sparkSession)
    shared = spark.sparkContext.broadcast((anchors, sample))  # MOST_ANCHORS vectors and SAMPLE_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, sample = shared.value
        step = max(1, (4 << 20) // len(anchors))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                place = places(_matrix(part.column(2)), anchors)
                first = np.argsort(place, axis=1, kind="stable")[:, :files]
                rows = pa.array(np.repeat(np.arange(part.num_rows), first.shape[1]))
                coded = pa.array([p.tobytes() for p in place], pa.binary())
                cut = np.zeros(len(place), np.int64)
                if sample is not None:
                    nth = max(0, ceil(share * len(sample)) - 1)
                    cut = np.array([np.partition(_footrule(sample, p), nth)[nth] for p in place])
                yield pa.RecordBatch.from_arrays([pa.array(first.ravel().astype(np.int32)), *[c.take(rows) for c in (*part.columns, coded, pa.array(cut))]], ["file", "row_id", "vec_id", "v", "place", "cut"])

    return vectors.select("row_id", "vec_id", "v").mapInArrow(run, "file int, row_id string, vec_id long, v array<double>, place binary, cut long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, anchors: int = ANCHORS, posted: int = POSTED, opened: int = OPENED, budget: int = BUDGET, shard_rows: int = SHARD_ROWS, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query among other ids.

    vectors and queries as :func:`usable` gives them.
    """
    spark = prepare(vectors.sparkSession)
    width = vectors.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not width:
        return spark.createDataFrame([], schema)
    vectors, queries = (x.where(F.size("v") == width[0]) for x in (vectors, queries))
    rows, asking = int(width[1]), queries.count()
    wanted = 1 if rows <= whole_rows else min(max(anchors, isqrt(rows)), MOST_ANCHORS, rows // 4)
    size = max(wanted, min(SAMPLE_ROWS, SAMPLE_BYTES // (2 * wanted)))
    sample = chosen_rows(vectors, size)
    chosen = sample[:wanted]
    files = min(len(chosen), ceil(opened * len(chosen) ** 0.5))
    share = min(1.0, budget * rows**0.5 / rows)
    shards = max(1, ceil(rows * min(1.0, 4 * posted / len(chosen)) / shard_rows))  # of a file, were it four times the average
    blocks = max(1, ceil(asking / QUERY_ROWS))  # of queries that meet a shard at a time
    held = post(vectors.withColumn("row_id", F.lit(None).cast("string")), chosen, posted).drop("row_id", "cut")
    held = held.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = post(_rows_apart(queries), chosen, files, places(sample, chosen), share).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _nearest(left, right, k, posted)
        return pa.table(found, schema=pa.schema([("row_id", pa.string()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    near = asked.groupBy("file", "shard", "block").cogroup(held.groupBy("file", "shard", "block")).applyInArrow(match, "row_id string, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id", "row_id").orderBy("score", "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    alike = F.substring_index("row_id", ":", 1).cast("int")
    return ranked.withColumn("_", F.explode(F.sequence(F.lit(1), alike))).select("query_id", "rank", "vec_id", "score")


def _rows_apart(queries: DataFrame) -> DataFrame:
    """Distinct queries with a row_id that tells those of one id apart and begins with the number of rows that are alike."""
    return queries.groupBy("vec_id", "v").count().select("vec_id", "v", F.concat_ws(":", "count", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).alias("row_id"))


def _nearest(asked: pa.Table, held: pa.Table, k: int, posted: int) -> dict[str, list]:
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if asked.num_rows and held.num_rows:
        file = asked["file"][0].as_py()
        x, ids = _matrix(held["v"].combine_chunks()), held["vec_id"].to_numpy()
        place = np.frombuffer(b"".join(held["place"].to_pylist()), np.uint16).reshape(len(ids), -1)
        x, place, ids, start, count = _entries(x, place, ids)
        posts = np.argsort(place, axis=1, kind="stable")[:, :posted]  # the files that an entry is posted in
        q, qid = _matrix(asked["v"].combine_chunks()), asked["vec_id"].to_numpy()
        qplace = np.frombuffer(b"".join(asked["place"].to_pylist()), np.uint16).reshape(len(qid), -1)
        near, cuts = place.astype(np.int16 if place.shape[1] < 1 << 15 else np.int32), asked["cut"].to_numpy()
        for i in range(len(qid)):
            before = qplace[i] < qplace[i][file]  # files that this query opens earlier
            mine = np.flatnonzero(~before[posts].any(1))
            if not len(mine):
                continue
            foot = _footrule(near[mine], qplace[i])
            limit = int(cuts[i])
            if not before.any() and len(mine) > k:
                limit = max(limit, int(np.partition(foot, k)[k]))
            mine = mine[foot <= limit]
            if not len(mine):
                continue
            d = np.sqrt(((x[mine] - q[i]) ** 2).sum(1))
            if len(mine) > k:  # one more than k, as the query itself may be among them
                cut = np.partition(d, k)[k]
                mine, d = mine[d <= cut], d[d <= cut]
            taken = np.minimum(count[mine], k + 1)
            got = np.concatenate([ids[start[m] : start[m] + n] for m, n in zip(mine, taken, strict=True)])
            gd = np.repeat(d, taken)
            other = got != qid[i]
            got, gd = got[other], gd[other]
            order = np.lexsort((got, gd))[:k]
            out.append((np.full(len(order), i), got[order], gd[order]))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    at, vec, score = [np.concatenate(c) for c in zip(*(out or [none]), strict=True)]
    rows = pa.array(at)
    return {"row_id": asked["row_id"].take(rows).combine_chunks(), "query_id": asked["vec_id"].take(rows).combine_chunks(), "vec_id": vec, "score": score}


def _entries(x: np.ndarray, place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal vectors as one entry: vectors, places, ids in order of entry and id, each entry's first id and count."""
    x = np.ascontiguousarray(x + 0.0)
    _, at, which = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, which))
    count = np.bincount(which, minlength=len(at))
    return x[at], place[at], ids[order], np.cumsum(count) - count, count


def op10_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of each row whose vec_id is divisible by 100, among all other rows."""
    rows = usable(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where(F.col("vec_id") % 100 == 0), 10)
