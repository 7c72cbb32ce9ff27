"""Connected components of an edge list: at once in one task, or by alternating large-star and small-star steps.

Up to ``WITHIN`` distinct edges (some 16 MB of 128-bit nodes) are one task, whatever their shape: a round of steps takes thousands of tasks for the same, and
what the driver notes of each task and plan adds up over the rounds. Only more edges than that go through rounds.

Every step is a grouped minimum (combined before the shuffle) that goes back to the edges. The edges of a hub, a node of over
``HUB`` edges and over a ``1 / HUBS`` of all, stay where they are and get it from a broadcast table of at most
``2 * HUBS`` rows; those of other nodes get it by an equi-join. Nothing but a row count and a checksum reaches the driver; each
round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemill.llm.common import ARROW_ROWS, discard, stash

HUB = 1000
HUBS = 10_000
WITHIN = 500_000


def _with_least(edges: DataFrame, size: int) -> DataFrame:
    """(a, b, m): m is the least b of a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    limit = max(HUB, size // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > limit).select("a", "m"))  # 2 * HUBS rows at most, as edges are counted from both ends
    others = edges.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("n") <= limit).select("a", "m"), "a")
    return others.select("a", "b", "m").unionByName(edges.join(hubs, "a").select("a", "b", "m"))


def _large(edges: DataFrame, size: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _with_least(both, size).withColumn("m", F.least("a", "m"))
    return low.where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame, size: int) -> DataFrame:
    low = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), size)
    over = low.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return over.unionByName(low.where("b = m").select("a", "b")).distinct()


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n is connected to."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, a, b)
        np.minimum.at(root, b, a)
        while not np.array_equal(root, further := root[root]):
            root = further
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, component) of edges that fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch.columns for batch in batches]
        a, b = (pa.chunked_array([p[k] for p in parts], arrow) for k in (0, 1))
        ends = pa.chunked_array([*a.chunks, *b.chunks], arrow).unique()
        nodes = ends.take(pc.sort_indices(ends))  # bytes and numbers are ordered as Spark orders them
        root = _roots(len(nodes), *(pc.index_in(c, nodes).to_numpy().astype(np.int64) for c in (a, b)))
        for at in range(0, len(nodes), ARROW_ROWS):
            yield pa.RecordBatch.from_arrays([nodes.slice(at, ARROW_ROWS), nodes.take(pa.array(root[at : at + ARROW_ROWS]))], ["node", "component"])

    kind = edges.schema["a"].dataType
    arrow = to_arrow_type(kind)
    return edges.coalesce(1).mapInArrow(run, f"node {kind.simpleString()}, component {kind.simpleString()}")


def components(edges: DataFrame, within: int = WITHIN) -> DataFrame:
    """(node, component): each node of an edge (a, b) with the least node it is connected to."""
    now = stash(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= within:
        found = stash(_at_once(now))
        discard(now)
        return found
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        wide = stash(_large(now, seen[0]))
        after = stash(_small(wide, seen[0]))
        discard(now)
        discard(wide)
        now = after
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
