"""Near duplicates by HyperMinHash sketches, with links confirmed on full shingle sets.

1. *Sketch.* A document's set is its distinct k-word shingles, as 64-bit hashes. The hash space is cut into ``registers``
   buckets; each keeps, of its least hash, the count of leading zeros and the next 10 bits (16 bits in all).
   Empty buckets borrow from others in an order fixed by their number, so that two sets agree in a register with their
   Jaccard similarity.
2. *Classes.* Documents with equal sets become one class (grouped minimum of the id); from here on, copies cost nothing.
3. *Bands.* Classes that agree in all registers of a band meet. In a band's group, pairs whose sizes allow the
   similarity and whose estimate is within ``ERRORS`` standard errors of it are joined up; the group emits one edge for each member
   at most. Members bring the last 4 bits of each register only, and the estimate is corrected for registers that are then equal by chance.
4. *Confirmation.* The components of those edges hold every link. The full sets of their members, and of no other
   documents, are brought together, and pairs are compared on full sets, best
   estimate first, except where links already found connect them. Again one edge for each member at most.
5. *Components* of the confirmed links, named by their smallest doc_id.

A link at the limit is lost if all bands miss it (below 1e-8 with the parameters used here) or if its estimate is under the limit by more than
``ERRORS`` standard errors in every band's group they meet in (about 1e-9 for a normal error). No group or
component is capped: one with more than ``block_rows`` members (or ``block_bytes`` of sets) is compared with one of its members first,
part by part, and only what that leaves alone with all others.

Cases: a text that is null or has no word has an empty set and is linked with nothing. A null doc_id takes part, but names
no component unless all of a component are null. Rows that repeat a doc_id are answered one by one, whether their texts are equal or not. Ties need no rule, as a
component's name is a minimum. Very long texts are hashed whole. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import discard, prepare, stash, text_hashes, unused
from tidemill.llm.components import components
from tidemill.tables import table

MANTISSA = 10
#: Bits of each register that travel with a document to compare it with others.
LOW = 4
#: Standard errors by which an estimate may stay under the limit.
ERRORS = 6
BLOCK_ROWS = 2000
BLOCK_BYTES = 24 << 20
_MEMO = 400_000
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


class Shingler:
    """Shingle sets of texts; hashes of words are looked up."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.memo = _WordHashes()

    def hashes(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct shingle hashes; empty without words."""
        tokens = (text or b"").lower().split()
        if not tokens:
            return np.zeros(0, np.uint64)
        h = np.array(list(map(self.memo.__getitem__, tokens)), np.uint64)
        n = min(self.words, len(h))
        acc = np.full(len(h) - n + 1, n if n < self.words else 0, np.uint64)
        for j in range(n):
            acc = _mix(acc * _U(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
        return np.unique(acc)


@cache
def _layout(registers: int) -> tuple[np.ndarray, np.ndarray]:
    """First hash of each bucket; for each bucket, all buckets in the order in which it borrows."""
    edges = np.array([-(-(i << 64) // registers) for i in range(registers)], np.uint64)
    rng = np.random.default_rng(20240229)
    return edges, np.stack([rng.permutation(registers) for _ in range(registers)])


def sketch(hashes: np.ndarray, registers: int) -> np.ndarray:
    """Compressed registers of a non-empty sorted set."""
    edges, borrow = _layout(registers)
    at = np.searchsorted(hashes, edges)
    filled = at < np.append(at[1:], len(hashes))
    least = hashes[np.minimum(at, len(hashes) - 1)] * _U(registers)  # wraps: the place in its bucket, over 64 bits
    top = np.frexp((least >> _U(11)).astype(np.float64))[1]  # of 53 bits
    zeros = 53 - top
    shifted = least << np.minimum(zeros + 1, 63).astype(np.uint64)
    value = (zeros.astype(np.uint16) << MANTISSA) | (shifted >> _U(64 - MANTISSA)).astype(np.uint16)
    if not filled.all():
        value = value[np.where(filled, np.arange(registers), borrow[np.arange(registers), filled[borrow].argmax(1)])]
    return value


def low_bits(regs: np.ndarray) -> bytes:
    """The last bits of all registers, two registers in a byte."""
    low = (regs & ((1 << LOW) - 1)).astype(np.uint8)
    return (low[0::2] | low[1::2] << LOW).tobytes()


def estimate(same: np.ndarray, registers: int, chance: float = 0.169919487 / (1 << MANTISSA)) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, without those that are equal by chance."""
    return np.maximum(0.0, (same / registers - chance) / (1 - chance))


def sketches(docs: DataFrame, words: int, registers: int) -> DataFrame:
    """doc_id, h1, h2, n_shingles, fp (128 bits of the set; null if empty), regs and their low bits of each row."""
    if registers % 2:
        raise ValueError("an even number of registers is needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.hashes(t) for t in batch.column(3).cast(pa.binary()).to_pylist()]
            fps = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            regs = [sketch(s, registers) if len(s) else None for s in sets]
            full, low = ([None if r is None else f(r) for r in regs] for f in (np.ndarray.tobytes, low_bits))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(full, pa.binary()), pa.array(low, pa.binary())], ["doc_id", "h1", "h2", "n_shingles", "fp", "regs", "low"])

    return docs.select("doc_id", "h1", "h2", "text").mapInArrow(run, "doc_id long, h1 long, h2 long, n_shingles long, fp binary, regs binary, low binary")


def _forest(n: int, pairs: Iterator[tuple[int, int]], linked) -> np.ndarray:
    """Roots after joining the pairs that ``linked`` confirms; pairs already connected aren't asked for."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b and (linked is None or linked(i, j)):
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def _near_pairs(low: np.ndarray, sizes: np.ndarray, left: int | None, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i < j) that may be linked, with the number of registers whose low bits are equal: all, or of the first ``left`` with the others."""
    m = low.shape[1]
    t, chance = percent / 100, 1 / (1 << LOW)
    p = chance + (1 - chance) * t
    slack = ERRORS * np.sqrt(p * (1 - p) / m) / (1 - chance)
    first, second, equal = [], [], []
    small = sizes < 64
    for i in range(len(low) - 1 if left is None else left):
        rest = np.arange(i + 1 if left is None else left, len(low))
        lo, hi = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[lo * 100 >= hi * percent]
        if not len(rest):
            continue
        same = (low[rest] == low[i]).sum(1)
        near = estimate(same, m, chance) >= t - slack - 0.15 * small[rest]
        if near.any():
            first.append(np.full(int(near.sum()), i))
            second.append(rest[near])
            equal.append(same[near])
    if not first:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(first), np.concatenate(second), np.concatenate(equal)


def _edges(fp: list[bytes], root: np.ndarray) -> pa.Table:
    child = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": pa.array([fp[i] for i in child], pa.binary()), "b": pa.array([fp[root[i]] for i in child], pa.binary())})


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Groups dealt over all shuffle partitions: rows are few bytes but much work, so AQE would merge too many into a task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _apart(df: DataFrame) -> DataFrame:
    """The frame with columns that Spark doesn't take for those of the frame it came from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _low(t: pa.Table) -> np.ndarray:
    packed = np.frombuffer(b"".join(t["low"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
    return np.stack([packed & ((1 << LOW) - 1), packed >> LOW], axis=2).reshape(t.num_rows, -1)


def _joined_up(members: DataFrame, key: str, roots: Callable[[pa.Table, int | None], np.ndarray], block_rows: int) -> DataFrame:
    """Edges (a, b) that connect in every group what ``roots`` connects; members has the key, fp, parts and what ``roots`` reads.

    Groups of one part are one task each. In larger ones every member is compared with one of them first, part by part; only those that
    this leaves alone are compared with all others, in pairs of parts. So what travels grows with the group, not with its square, as far as
    its members are copies of one text.
    """

    def alone(t: pa.Table) -> pa.Table:
        return _edges(t["fp"].to_pylist(), roots(t, None))

    edges = _dealt(members.where("parts = 1"), key).groupBy(key).applyInArrow(alone, "a binary, b binary")
    large = members.where("parts > 1")
    if large.isEmpty():
        return edges
    own = large.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    least = large.groupBy(key).agg(F.min("fp").alias("fp"))
    first = large.join(least, [key, "fp"]).withColumn("i", every("parts"))

    def with_first(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return right.select([key, "fp", "parts", "fp"]).rename_columns([key, "fp", "parts", "b"])
        at = roots(pa.concat_tables([left.slice(0, 1), right.select(left.column_names)]), 1)
        b = [left["fp"][0].as_py() if r == 0 else None for r in at[1:]]
        return pa.table({key: right[key], "fp": right["fp"], "parts": right["parts"], "b": pa.array(b, pa.binary())})

    kind = large.schema[key].dataType.simpleString()
    star = stash(_apart(first).groupBy(key, "i").cogroup(own.groupBy(key, "i")).applyInArrow(with_first, f"{key} {kind}, fp binary, parts long, b binary"))
    rest = star.where("b is null")
    left_parts = rest.groupBy(key, "parts").agg(F.ceil(F.count("*") / block_rows).alias("rest")).withColumn("i", every("parts")).drop("parts")
    left = large.join(rest.select(key, "fp"), [key, "fp"]).withColumn("i", every("parts")).join(left_parts, [key, "i"])
    left = left.withColumn("j", F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("rest")).cast("int"))
    right = own.join(left_parts, [key, "i"]).withColumn("j", every("rest"))

    def with_rest(left: pa.Table, right: pa.Table) -> pa.Table:
        both = pa.concat_tables([left, right.select(left.column_names)])
        return _edges(both["fp"].to_pylist(), roots(both, left.num_rows))

    more = _apart(left).groupBy(key, "i", "j").cogroup(right.groupBy(key, "i", "j")).applyInArrow(with_rest, "a binary, b binary")
    return edges.unionByName(star.where("b is not null").select(F.col("fp").alias("a"), "b")).unionByName(more)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 4, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row; doc_id and text are read."""
    found = grouped(docs, words, percent, bands, rows, block_rows, block_bytes)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def grouped(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 4, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), n_shingles, component_id and whether the row is its group's first, by doc_id (null last) and hashes."""
    spark = prepare(docs.sparkSession)
    h1, h2 = text_hashes()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), "text")
    sk = stash(sketches(docs, words, bands * rows))
    full = sk.where("fp is not null")
    ident = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")
    classes = stash(full.groupBy("fp").agg(F.min(ident).alias("doc"), F.min(F.struct("n_shingles", "regs", "low")).alias("s")).select("fp", "doc", "s.*"))
    met, near = _candidates(classes, percent, bands, rows, block_rows)
    candidate = components(near).select(F.col("node").alias("fp"), F.col("component").alias("comp"))
    discard(met)
    whole, links = _confirm(docs, classes, candidate, words, percent, block_rows, block_bytes)
    linked = components(links).select(F.col("node").alias("fp"), "component")
    discard(whole)
    named = linked.join(classes.select("fp", "doc"), "fp").groupBy("component").agg(F.min("doc").alias("first"))
    of = linked.join(named, "component").select("fp", "first")
    ids = stash(classes.select("fp", "doc").join(of, "fp", "left").select("fp", F.coalesce("first", "doc").alias("first")))
    discard(classes)
    answered = full.join(ids, "fp").select("doc_id", "h1", "h2", "n_shingles", F.col("first.doc_id").alias("component_id"), (ident == F.col("first")).alias("is_first"))
    alone = sk.where("fp is null").select("doc_id", "h1", "h2", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("is_first"))
    return answered.unionByName(alone)


def _candidates(classes: DataFrame, percent: int, bands: int, rows: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """A stashed table to discard, and edges (a, b) within bands' groups, whose components hold every link."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = 2 * rows
            keys = [xxhash.xxh3_64_intdigest(r[b * width : (b + 1) * width], b) for r in batch.column(1).to_pylist() for b in range(bands)]
            again = pa.array(np.repeat(np.arange(batch.num_rows), bands))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), batch.column(0).take(again)], ["key", "fp"])

    keyed = classes.select("fp", "regs").mapInArrow(band, "key long, fp binary")
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = stash(keyed.join(shared, "key").select("key", "fp", F.ceil(F.col("size") / block_rows).alias("parts")))

    def roots(t: pa.Table, left: int | None) -> np.ndarray:
        i, j, _ = _near_pairs(_low(t), t["n_shingles"].to_numpy(), left, percent)
        return _forest(t.num_rows, zip(i.tolist(), j.tolist(), strict=True), None)

    return met, _joined_up(met.join(classes.select("fp", "n_shingles", "low"), "fp"), "key", roots, block_rows)


def _confirm(docs: DataFrame, classes: DataFrame, candidate: DataFrame, words: int, percent: int, block_rows: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """A stashed table to discard, and edges (a, b) of confirmed links that connect whatever all links do."""
    members = candidate.join(classes.drop("regs"), "fp")
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n_shingles") * 8 / block_bytes)).alias("parts"))
    members = members.join(sizes, "comp").select("fp", "comp", "parts", "n_shingles", "low", F.col("doc.doc_id").alias("doc"), F.col("doc.h1").alias("k1"), F.col("doc.h2").alias("k2"))
    same = docs["doc_id"].eqNullSafe(members["doc"]) & (docs["h1"] == members["k1"]) & (docs["h2"] == members["k2"])
    held = [F.first(c).alias(c) for c in ("text", "comp", "parts", "n_shingles", "low")]
    got = docs.join(members, same).groupBy("fp").agg(*held)  # a row that repeats is needed once

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            found = [shingler.hashes(t).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found, pa.binary())], ["fp", "comp", "parts", "n_shingles", "low", "hashes"])

    whole = stash(got.mapInArrow(sets, "fp binary, comp binary, parts long, n_shingles long, low binary, hashes binary"))

    def roots(t: pa.Table, left: int | None) -> np.ndarray:
        raw, size = t["hashes"].to_pylist(), t["n_shingles"].to_numpy()
        held: dict[int, set[int]] = {}

        def of(i: int) -> set[int]:
            if i not in held:
                held[i] = set(np.frombuffer(raw[i], np.uint64).tolist())
            return held[i]

        def linked(i: int, j: int) -> bool:
            both = len(of(i) & of(j))
            return 100 * both >= percent * (int(size[i]) + int(size[j]) - both)

        i, j, same = _near_pairs(_low(t), size, left, percent)
        order = np.argsort(-same, kind="stable")
        return _forest(t.num_rows, zip(i[order].tolist(), j[order].tolist(), strict=True), linked)

    return whole, _joined_up(whole, "comp", roots, block_rows)


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 4) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id, a null one last; of several texts with that id, the first by hash. Rows without words all stay.

    Rows are told apart by doc_id and text, and of rows equal in both, one stays.
    """
    found = grouped(docs, words, percent, bands, rows).where("is_first")
    i, a, b = unused(docs, "id", "h1", "h2")
    kept = stash(found.groupBy(F.col("doc_id").alias(i), F.col("h1").alias(a), F.col("h2").alias(b)).agg((F.count("*") == 1).alias("once"), F.max("n_shingles").alias("size")))
    h1, h2 = text_hashes()
    mine = docs.withColumn(a + "_", h1).withColumn(b + "_", h2)
    own = [F.col(f"`{c}`") for c in docs.columns]

    def of(some: DataFrame) -> DataFrame:
        some = some.select(i, a, b)
        return mine.join(some, mine["doc_id"].cast("long").eqNullSafe(some[i]) & (mine[a + "_"] == some[a]) & (mine[b + "_"] == some[b]), "left_semi").select(*own)

    once = of(kept.where("once or size = 0"))
    again = kept.where("not once and size > 0")
    if again.isEmpty():
        return once
    return once.unionByName(of(stash(again)).dropDuplicates(["doc_id", "text"]))  # few rows, as a rule, which Spark then broadcasts under its checked threshold


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over 3-word shingles at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85, bands=32, rows=5)
