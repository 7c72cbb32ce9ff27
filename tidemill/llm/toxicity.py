"""Toxicity scores from a factorization machine over hashed terms.

The model is ``b + x.w + 1/2 * sum_f((x.V_f)^2 - x^2.V_f^2)`` over the presence of hashed terms:
the pairwise part learns that two terms matter together, which additive weights can't express.

Every hashed bucket that a labelled row of the sample holds gets a weight and factors; none is left out, as a term may matter in pairs
alone. A bucket counts by n / (n + ``SHRINK``), n being the sampled rows that have it, so chance findings of rare terms weigh little.
Weights are learned by a proximal update that leaves those at 0 whose evidence stays under ``L1``, factors by adaptive steps with an L2 penalty.

Fitting reads a bounded sample of labelled rows to the driver (``sample_rows`` rows and ``sample_terms`` distinct terms of rows at most,
in order of a hash of the id), so the model has at most ``2**bits`` buckets, whatever the corpus. Scoring is one pass
over whole texts without a shuffle.

Cases: a null or empty text has no terms and gets the model's base rate. Rows without a label, or with a null
label, aren't learned from; a doc_id labelled more than once counts as toxic if any of its rows does, and each document row with that id
is a row of the sample. With no labelled rows every score is 0. Texts of any length are scored whole. Repeated rows are scored alike, one row out for each row in. Columns other than those named
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import discard, prepare, remainder, stash, widened, without
from tidemill.tables import table

BITS = 18
SAMPLE_ROWS = 20_000
SAMPLE_TERMS = 20_000_000
FACTORS = 8
THRESHOLD = 0.3
SHRINK = 20
L1 = 8.0
_EDGE = ".,;:!?\"'()[]{}<>|*#%&$@_-~`+=/\\"


def term_buckets(text: str | None, mask: int) -> set[int]:
    """Hashed distinct terms: lower case, without punctuation at their ends."""
    words = {w.strip(_EDGE) for w in set((text or "").lower().split())}
    words.discard("")
    return {zlib.crc32(w.encode("utf-8", "surrogatepass")) & mask for w in words}


@dataclass
class FactorizationMachine:
    """Weights and factors by bucket, 0 where nothing was learned; an unfitted model scores 0."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mask: int

    def raw(self, buckets: np.ndarray) -> float:
        v = self.factors[buckets]
        s = v.sum(0)
        return float(self.bias + self.weights[buckets].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.bias == -np.inf:
            return np.zeros(len(texts))
        found = [term_buckets(t, self.mask) for t in texts]
        out = np.array([self.raw(np.sort(np.fromiter(b, np.int64, len(b)))) for b in found])
        return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40)))


@dataclass
class _Batch:
    """Rows of a batch one after another: features as numbers of the batch's distinct ones, which come in order."""

    size: np.ndarray
    start: np.ndarray
    distinct: np.ndarray
    inverse: np.ndarray
    order: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> _Batch:
        flat, size = np.concatenate(rows), np.array([len(r) for r in rows])
        order = np.argsort(flat, kind="stable")
        new = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))
        inverse = np.empty(len(flat), np.int64)
        inverse[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return cls(size, np.cumsum(size) - size, flat[order][first], inverse, order, first)


def fit_machine(rows: list[np.ndarray], y: np.ndarray, d: int, factors: int = FACTORS, epochs: int = 5, rate: float = 0.3, factor_rate: float = 0.01, l1: float = L1, l2: float = 20.0, shrink: float = SHRINK, start: float = 0.01, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors of d features by mini-batches of presence rows: log loss, see the module's text."""
    rng = np.random.default_rng(seed)
    n = len(rows)
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    bias, weight, factor = np.log(p / (1 - p)), np.zeros(d), rng.normal(0, start, (d, factors))
    seen = sum(np.bincount(np.concatenate(rows[at : at + 1000]), minlength=d) for at in range(0, n, 1000))
    value = seen / (seen + shrink)
    touched = -np.expm1(-seen * 256 / n)  # how often a batch has the feature: a penalty is due for all batches
    push, square, factor_square, bias_square = np.zeros(d), np.zeros(d), np.ones((d, factors)), 1.0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            pick = [i for i in order[at : at + 256] if len(rows[i])]
            if not pick:
                continue
            b = _Batch.of([rows[i] for i in pick])
            x, u = value[b.distinct], b.distinct
            scaled = factor[u] * x[:, None]
            v = scaled[b.inverse]
            s = np.add.reduceat(v, b.start, axis=0)
            z = bias + np.add.reduceat((weight[u] * x)[b.inverse], b.start) + 0.5 * ((s**2).sum(1) - np.add.reduceat((v**2).sum(1), b.start))
            error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]
            each = np.repeat(error, b.size)
            total = np.bincount(b.inverse, weights=each, minlength=len(u))
            g = total * x
            grown = square[u] + g**2
            push[u] += g - (np.sqrt(grown) - np.sqrt(square[u])) / rate * weight[u]
            square[u] = grown
            weight[u] = np.where(np.abs(push[u]) <= l1, 0.0, -(push[u] - np.sign(push[u]) * l1) / ((1 + np.sqrt(grown)) / rate + 1.0))
            pulled = np.add.reduceat((each[:, None] * np.repeat(s, b.size, axis=0))[b.order], b.first, axis=0)
            g = (pulled - total[:, None] * scaled) * x[:, None] + (l2 * 256 / n / touched[u])[:, None] * factor[u]
            factor_square[u] += g**2
            factor[u] -= factor_rate * g / np.sqrt(factor_square[u])
            bias_square += error.sum() ** 2
            bias -= 0.1 * error.sum() / np.sqrt(bias_square)
    return float(bias), weight * value, factor * value[:, None]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample_rows: int = SAMPLE_ROWS, sample_terms: int = SAMPLE_TERMS, bits: int = BITS, **training: float) -> FactorizationMachine:
    """Learn from at most ``sample_rows`` labelled rows; ``learn`` says which ids may be learned from."""
    prepare(spark)
    mask = (1 << bits) - 1
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(F.lit(True) if learn is None else learn)
    labelled = labelled.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("y", F.xxhash64("doc_id").alias("key"), F.xxhash64("text").alias("text_key"), "text")  # at most sample_rows short rows

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(term_buckets(t, mask)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), *batch.columns[1:3], pa.array([len(b) for b in found], pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["y", "key", "text_key", "n", "buckets"])

    seen = stash(rows.mapInArrow(hashed, "y int, key long, text_key long, n long, buckets array<int>"))
    first = ["key", "text_key", "y"]
    sizes = np.array([r.n for r in seen.select(*first, "n").orderBy(*first).limit(sample_rows).select("n").collect()], np.int64)
    kept = int(np.searchsorted(np.cumsum(sizes), sample_terms, side="right"))
    got = seen.orderBy(*first).limit(max(kept, 1)).select("y", "buckets").toArrow()
    discard(seen)
    flat = got["buckets"].combine_chunks().flatten().to_numpy() if got.num_rows else np.zeros(0, np.int32)
    weights, factors = np.zeros(mask + 1, np.float32), np.zeros((mask + 1, FACTORS), np.float32)
    if not got.num_rows:
        return FactorizationMachine(-np.inf, weights, factors, mask)
    held = np.zeros(mask + 1, bool)
    held[flat] = True
    buckets = np.flatnonzero(held)
    numbers = (np.cumsum(held, dtype=np.int32) - 1)[flat]  # not by a sort, which takes several times the memory of the terms
    lists = np.split(numbers, np.cumsum(pc.list_value_length(got["buckets"]).to_numpy())[:-1])
    bias, weights[buckets], factors[buckets] = fit_machine(lists, got["y"].to_numpy().astype(float), len(buckets), **training)
    return FactorizationMachine(bias, weights, factors, mask)


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to the given columns, in place of any so named; only ``text`` is read."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    docs = without(docs, "score", "predicted")
    names = docs.columns
    at = names.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(scored, widened(docs, "score double, predicted int"))


def rejected_removed(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score under the threshold, with their columns as they are."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(kept, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned from ids whose crc32 mod 4 is not 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(spark, docs, labels, remainder(4) != 2)
    out = score(docs.select("doc_id", (remainder(4) == 2).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted")
