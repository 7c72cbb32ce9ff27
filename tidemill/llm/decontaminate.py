"""Benchmark decontamination by latent semantic retrieval.

1. *Terms.* Only words of the benchmark can be shared with it, so texts become sequences of the numbers of its words (0: any other
   word). A benchmark of more than ``MAX_TERMS`` different words has the buckets of a hash for numbers, as many, and so has every text. Passages are windows of two neighbouring blocks of ``BLOCK`` words; a term's weight is its inverse
   frequency over all blocks of all documents, 0 for function words (those of over ``common`` of the benchmark's passages).
2. *Latent space.* The weighted passages of all documents, and those of the benchmark with equal total weight, form the matrix A.
   A randomised SVD finds its leading right singular vectors from A'A times random vectors, summed over
   tasks in one pass (the Nystrom form for a positive matrix).
3. *Candidates.* Every passage is compared with every benchmark passage by cosine: the benchmark is the query set. A benchmark passage that the
   leading ``dims`` vectors hold only in part is compared by that part.
4. *Checks.* A candidate is confirmed if the longest common subsequence with the words around it has at least ``lcs`` of the
   benchmark passage's words, and ``answer`` of the answer's words occur there: those of the answer column, if there is one. Without, the
   answer is taken to be the last third of the passage's weighted terms, as items end with their answer, and isn't asked for where the
   subsequence has ``sure`` of the words. Word order and answer words tell a paraphrase from a text on the same matter.

Terms, weights and space are those of the whole benchmark; only the comparison goes over it in blocks of at most ``MAX_PASSAGES``
passages, each a pass over the documents, so what is found doesn't depend on them. What is broadcast or summed is bounded by
``MAX_TERMS``, ``dims`` and that block. Nothing of the documents reaches the driver but sums of that size.

Cases: a null or empty text, or a benchmark item without a word, matches nothing. Repeated documents or items are each
answered, a pair once for each row of the document. Ties in cosine go to the first window. Texts and answers of any length are read whole. An empty benchmark or an
empty document table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import discard, prepare, stash, text_hashes, unused
from tidemill.tables import table

BLOCK = 32
DIMS = 128
OVERSAMPLE = 32
COSINE = 0.45
LCS = 0.6
ANSWER = 0.5
SURE = 0.8
COMMON = 0.025
MAX_TERMS = (1 << 16) - 1
MAX_PASSAGES = 16_384
MAX_ANSWERS = 4 << 20
SUM_TASKS = 4096
_MEMO = 500_000
_SEGMENT = 1 << 20  # words of a long text that are worked on at a time
_PAIRS = 1 << 15
_CHUNK = 8192  # numbers in a row of a summed vector
_SPACES = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()


class _Hashed(dict):
    """The number of a word's bucket, looked up or hashed."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        got = self[word] = 1 + zlib.crc32(word) % self.buckets
        return got


@dataclass
class Numbering:
    """Numbers of words, from 1 to ``size``; ``words`` is None where they are hashed."""

    words: dict[bytes, int] | None
    size: int

    @classmethod
    def of(cls, benchmark: DataFrame, columns: list[str]) -> Numbering:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = {w for c in batch.columns for t in c.to_pylist() for w in words_of(t)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["word"])

        words = benchmark.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, "word binary").distinct()
        got = [bytes(r.word) for r in words.limit(MAX_TERMS + 1).collect()]
        return cls({w: i for i, w in enumerate(sorted(got), 1)}, len(got)) if len(got) <= MAX_TERMS else cls(None, MAX_TERMS)

    def coder(self) -> Callable[[list[bytes]], np.ndarray]:
        if self.words is None:
            get = _Hashed(self.size).__getitem__
            return lambda words: np.fromiter(map(get, words), np.uint16, len(words))
        get = self.words.get
        return lambda words: np.fromiter(map(get, words, repeat(0)), np.uint16, len(words))


def passages_of(benchmark: DataFrame, numbering: Numbering, item_id: str, text: str, answer: str | None) -> DataFrame:
    """item, terms (two bytes a word) and answer (distinct terms; null without) of each passage; items longer than a window become several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = numbering.coder()
        for batch in batches:
            items, terms, answers = [], [], []
            for item, body, reply in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, wanted = words_of(body), np.unique(code(words_of(reply)))
                starts = [0] if len(words) <= 2 * BLOCK else [*range(0, len(words) - 2 * BLOCK, BLOCK), len(words) - 2 * BLOCK]
                for at in starts if words else []:
                    items.append(item)
                    terms.append(code(words[at : at + 2 * BLOCK]).tobytes())
                    answers.append(wanted.tobytes() if len(wanted) else None)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.binary()), pa.array(answers, pa.binary())], ["item", "terms", "answer"])

    columns = [F.col(f"`{item_id}`").cast("long"), F.col(f"`{text}`"), F.col(f"`{answer}`") if answer else F.lit(None).cast("string")]
    return benchmark.select(*columns).mapInArrow(run, "item long, terms binary, answer binary")


@dataclass
class Queries:
    """A block of benchmark passages: item, term numbers, and the answer's (None if not given) of each."""

    items: list[int]
    terms: list[np.ndarray]
    answers: list[np.ndarray | None]


def query_blocks(passages: DataFrame) -> Iterator[Queries]:
    """The passages in blocks of bounded size."""
    block, size = Queries([], [], []), 0
    for item, terms, reply in passages.toLocalIterator():
        if block.items and (len(block.items) >= MAX_PASSAGES or size > MAX_ANSWERS):
            yield block
            block, size = Queries([], [], []), 0
        block.items.append(item)
        block.terms.append(np.frombuffer(terms, np.uint16))
        block.answers.append(None if reply is None else np.frombuffer(reply, np.uint16))
        size += len(reply or b"")
    if block.items:
        yield block


def encoded(docs: DataFrame, numbering: Numbering) -> DataFrame:
    """doc_id, h1, h2 and terms (two bytes a word) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(numbering)  # MAX_TERMS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value.coder()
        for batch in batches:
            found = [code(words_of(text)).tobytes() for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["doc_id", "h1", "h2", "terms"])

    h1, h2 = text_hashes()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), "text").mapInArrow(run, "doc_id long, h1 long, h2 long, terms binary")


@dataclass
class Blocks:
    """Presence of terms in blocks, and the windows of neighbouring blocks, of a run of texts."""

    block: np.ndarray  # of each (block, term) pair, sorted by block
    term: np.ndarray
    first: np.ndarray  # blocks of each window (the same twice in a text of one block)
    second: np.ndarray
    n: int


def blocks_of(segments: list[np.ndarray], weighted: np.ndarray) -> Blocks:
    """weighted[t]: whether term t has a weight."""
    counts = [max(1, -(-len(s) // BLOCK)) for s in segments]
    starts = np.cumsum([0, *counts])
    pairs = []
    for s, at in zip(segments, starts, strict=False):
        here = np.flatnonzero(weighted[s])
        pairs.append((at + here // BLOCK).astype(np.int64) << 16 | s[here])
    key = np.sort(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    last = np.concatenate([np.full(c, at + c - 1) for c, at in zip(counts, starts, strict=False)]) if counts else np.zeros(0, np.int64)
    one = np.concatenate([np.full(c, c == 1) for c in counts]) if counts else np.zeros(0, bool)
    every = np.arange(starts[-1])
    first = every[(every < last) | one]
    return Blocks(key >> 16, key & 0xFFFF, first, np.minimum(first + 1, last[first]), int(starts[-1]))


def _project(b: Blocks, table_: np.ndarray) -> np.ndarray:
    """For each block, the sum of its terms' rows."""
    out = np.zeros((b.n, table_.shape[1]), np.float32)
    for at in range(0, len(b.block), _PAIRS):
        block, term = b.block[at : at + _PAIRS], b.term[at : at + _PAIRS]
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        out[block[starts]] += np.add.reduceat(table_[term], starts, axis=0)
    return out


def _scatter(b: Blocks, rows: np.ndarray, into: np.ndarray) -> None:
    """Add each block's row to the rows of its terms."""
    for at in range(0, len(b.block), _PAIRS):
        order = np.argsort(b.term[at : at + _PAIRS], kind="stable")
        term, block = b.term[at : at + _PAIRS][order], b.block[at : at + _PAIRS][order]
        starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        into[term[starts]] += np.add.reduceat(rows[block], starts, axis=0)


def _squares(b: Blocks, weight: np.ndarray) -> np.ndarray:
    """Squared length of each window; a term of both its blocks counts twice."""
    key = b.block << 16 | b.term
    at = np.minimum(np.searchsorted(key, key + (1 << 16)), max(0, len(key) - 1))
    again = key[at] == key + (1 << 16)
    square = weight[b.term] ** 2
    own = np.bincount(b.block, weights=square, minlength=b.n)
    both = np.bincount(b.block[again], weights=square[again], minlength=b.n)
    return np.where(b.first == b.second, own[b.first], own[b.first] + own[b.second] + 2 * both[b.first])


def gram_times(b: Blocks, weight: np.ndarray, random: np.ndarray, into: np.ndarray) -> int:
    """Add A'A times random, A having the windows of b as unit rows; the number of windows that have a term."""
    square = _squares(b, weight)
    some = square > 0
    first, second = b.first[some], b.second[some]
    y = _project(b, (weight[:, None] * random).astype(np.float32))
    twice = (first != second)[:, None]
    rows = (y[first] + y[second] * twice) / square[some][:, None].astype(np.float32)
    back = np.zeros_like(y)
    np.add.at(back, first, rows)
    np.add.at(back, second, rows * twice)
    _scatter(b, back, into)
    return int(some.sum())


def _segments(values: list[bytes]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Row numbers and term sequences, a bounded number of words at a time; parts of a long text overlap by four blocks."""
    rows, held, size = [], [], 0
    for row, raw in enumerate(values):
        terms = np.frombuffer(raw, np.uint16)
        for at in range(0, max(1, len(terms) - 4 * BLOCK), _SEGMENT):
            part = terms[at : at + _SEGMENT + 4 * BLOCK]
            if held and size + len(part) > _SEGMENT:
                yield rows, held
                rows, held, size = [], [], 0
            rows.append(row)
            held.append(part)
            size += len(part)
    if held:
        yield rows, held


def summed(partials: DataFrame, length: int) -> np.ndarray:
    """The sum of vectors that tasks give as (task, chunk, part), by two levels of bounded groups, each in order of task."""

    def add(t: pa.Table) -> pa.Table:
        order = np.argsort(t["task"].to_numpy(), kind="stable")
        parts = t["part"].to_pylist()
        total = np.zeros(len(parts[0]) // 8)
        for i in order:
            total += np.frombuffer(parts[i])
        return pa.table({"task": pa.array([int(t["task"][0].as_py()) // width]), "chunk": t["chunk"].slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    width = max(1, int(np.ceil(np.sqrt(partials.rdd.getNumPartitions()))))
    schema = "task long, chunk int, part binary"
    once = partials.withColumn("level", F.floor(F.col("task") / width)).groupBy("chunk", "level").applyInArrow(add, schema)
    out = np.zeros(length)
    for row in once.groupBy("chunk").applyInArrow(add, schema).toLocalIterator():
        out[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["part"])
    return out


def _rows(vector: np.ndarray) -> pa.RecordBatch:
    task = TaskContext.get().partitionId()
    parts = [vector[at : at + _CHUNK].tobytes() for at in range(0, len(vector), _CHUNK)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), task)), pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], ["task", "chunk", "part"])


def _added(rows: DataFrame, length: int, add: Callable[[list[bytes], np.ndarray], None]) -> np.ndarray:
    """The sum over tasks of what ``add`` puts into a vector from the terms of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            add(batch.column(0).to_pylist(), total)
        if total.any():  # a task without a benchmark word has nothing to add
            yield _rows(total)

    few = rows.select("terms")
    few = few.coalesce(SUM_TASKS) if few.rdd.getNumPartitions() > SUM_TASKS else few
    return summed(few.mapInArrow(run, "task long, chunk int, part binary"), length)


def block_frequency(texts: DataFrame, n_terms: int) -> np.ndarray:
    """In how many blocks each term occurs; at 0, the number of blocks."""
    weighted = np.ones(n_terms + 1, bool)
    weighted[0] = False

    def add(values: list[bytes], total: np.ndarray) -> None:
        for _, held in _segments(values):
            b = blocks_of(held, weighted)
            total += np.bincount(b.term, minlength=n_terms + 1)
            total[0] += b.n

    return _added(texts, n_terms + 1, add)


def term_weights(passages: DataFrame, frequency: np.ndarray, common: float) -> np.ndarray:
    """Inverse block frequency; 0 for words of many passages, but for those of a passage that would keep fewer than three words."""
    n = len(frequency)

    def count(values: list[bytes], total: np.ndarray) -> None:
        for raw in values:
            total[np.unique(np.frombuffer(raw, np.uint16))] += 1
        total[0] += len(values)  # no term of the benchmark has number 0

    by_passage = _added(passages, n, count)
    function = by_passage > max(2.0, common * by_passage[0])

    def needed(values: list[bytes], total: np.ndarray) -> None:
        for raw in values:
            s = np.unique(np.frombuffer(raw, np.uint16))
            if (~function[s]).sum() < 3:
                total[s] += 1

    function &= _added(passages, n, needed) == 0
    weight = np.log1p(frequency[0] / np.maximum(frequency, 1.0))
    weight[function] = 0.0
    weight[0] = 0.0
    return weight


def latent_basis(texts: DataFrame, passages: DataFrame, weight: np.ndarray, dims: int, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors of all passages by a randomised SVD; see the module's text."""
    n = len(weight)
    width = min(n, dims + OVERSAMPLE)
    random = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    shared = texts.sparkSession.sparkContext.broadcast((weight, random))

    def times(values: list[bytes], total: np.ndarray) -> None:
        weight, random = shared.value
        for _, held in _segments(values):
            total[-1] += gram_times(blocks_of(held, weight > 0), weight, random, total[:-1].reshape(n, width))

    got, mine = (_added(rows, n * width + 1, times) for rows in (texts, passages))
    z = weight[:, None] * (got[:-1] + mine[:-1] * (max(1.0, got[-1]) / max(1.0, mine[-1]))).reshape(n, width)
    shift = np.finfo(float).eps * max(np.linalg.norm(z), 1.0) * np.sqrt(n)
    z = z + shift * random
    middle = random.T @ z
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    good = values > values.max() * 1e-12
    basis, _, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return basis[:, :dims]


@dataclass
class Latent:
    """terms: each term's weight times its row of the basis; targets: latent directions of benchmark passages, and how much of each the space holds."""

    weight: np.ndarray
    terms: np.ndarray
    targets: np.ndarray
    held: np.ndarray


def latent_space(queries: Queries, weight: np.ndarray, basis: np.ndarray) -> Latent:
    targets = np.zeros((len(queries.terms), basis.shape[1]))
    for i, t in enumerate(queries.terms):
        t = np.unique(t)
        targets[i] = weight[t] @ basis[t] / max(np.linalg.norm(weight[t]), 1e-12)
    held = np.linalg.norm(targets, axis=1)
    targets /= np.maximum(held, 1e-12)[:, None]
    return Latent(weight, (weight[:, None] * basis).astype(np.float32), targets.astype(np.float32), held)


def lcs_length(pattern: np.ndarray, region: np.ndarray) -> int:
    """Longest common subsequence, bit-parallel over the pattern."""
    masks: dict[int, int] = {}
    for i, t in enumerate(pattern.tolist()):
        masks[t] = masks.get(t, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    row = full
    for t in region.tolist():
        m = masks.get(t)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(pattern) - row.bit_count()


def contaminated(docs: DataFrame, benchmark: DataFrame, dims: int = DIMS, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER, sure: float = SURE, common: float = COMMON, item_id: str = "item_id", text: str = "text", answer_column: str | None = None) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), item_id, cosine, lcs, answer, word_start of each row of docs and each item whose passage it holds."""
    spark = prepare(docs.sparkSession)
    schema = "row long, doc_id long, h1 long, h2 long, item_id long, cosine double, lcs double, answer double, word_start long"
    out = spark.createDataFrame([], schema)
    numbering = Numbering.of(benchmark, [text, *([answer_column] if answer_column else [])])
    if not numbering.size:
        return out.drop("row")
    passages = stash(passages_of(benchmark, numbering, item_id, text, answer_column))
    texts = stash(encoded(docs, numbering).select(F.monotonically_increasing_id().alias("row"), "*"))
    weight = term_weights(passages, block_frequency(texts, numbering.size), common)
    basis = latent_basis(texts, passages, weight, dims)
    for queries in query_blocks(passages):
        out = out.unionByName(_search(texts, queries, latent_space(queries, weight, basis), cosine, lcs, answer, sure, schema))
    discard(passages)
    # An item's passages may lie in several blocks; the nearest one that was confirmed tells of the pair.
    nearest = F.min_by(F.struct("doc_id", "h1", "h2", "cosine", "lcs", "answer", "word_start"), F.struct(-F.col("cosine"), "word_start", "lcs"))
    return out.groupBy("row", "item_id").agg(nearest.alias("best")).select("best.doc_id", "best.h1", "best.h2", "item_id", *[f"best.{c}" for c in ("cosine", "lcs", "answer", "word_start")])


def _search(texts: DataFrame, queries: Queries, space: Latent, cosine: float, lcs: float, answer: float, sure: float, schema: str) -> DataFrame:
    wanted = []
    for t, given in zip(queries.terms, queries.answers, strict=True):
        own = list(dict.fromkeys(int(x) for x in t if space.weight[x] > 0))
        wanted.append(np.array(own[-max(1, -(-len(own) // 3)) :], np.uint16) if given is None else given)
    asked = [given is not None for given in queries.answers]
    shared = texts.sparkSession.sparkContext.broadcast((space, queries.items, queries.terms, wanted, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, items, terms, wanted, asked = shared.value
        least = cosine * space.held
        step = max(1, (1 << 22) // max(1, len(items)))
        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}
            for rows, held in _segments(batch.column(4).to_pylist()):
                b = blocks_of(held, space.weight > 0)
                square = _squares(b, space.weight)
                some = np.flatnonzero(square > 0)
                y = _project(b, space.terms)
                starts = np.cumsum([0, *[max(1, -(-len(s) // BLOCK)) for s in held]])
                tried: list[tuple[float, int, int]] = []
                for at in range(0, len(some), step):
                    w = some[at : at + step]
                    x = y[b.first[w]] + y[b.second[w]] * (b.first[w] != b.second[w])[:, None]
                    near = (x @ space.targets.T) / np.sqrt(square[w])[:, None]
                    n, q = np.nonzero(near >= least)
                    tried += zip((-near[n, q] / space.held[q]).tolist(), b.first[w[n]].tolist(), q.tolist(), strict=True)
                for minus, block, q in sorted(tried):
                    k = int(np.searchsorted(starts, block, side="right")) - 1
                    pair = (rows[k], items[q])
                    if pair in best:
                        continue
                    at = max(0, (block - int(starts[k]) - 1) * BLOCK)
                    region = held[k][at : at + 4 * BLOCK]
                    share = lcs_length(terms[q], region) / len(terms[q])
                    there = float(np.isin(wanted[q], region).mean()) if len(wanted[q]) else 1.0
                    if share >= lcs and (there >= answer or (share >= sure and not asked[q])):
                        best[pair] = (-minus, share, there, at)
            if best:
                rows = pa.array([row for row, _ in best])
                cols = [[item for _, item in best], *map(list, zip(*best.values(), strict=True))]
                types = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns[:4]], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["row", "doc_id", "h1", "h2", "item_id", "cosine", "lcs", "answer", "word_start"])

    return texts.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark; rows are told apart by doc_id and text."""
    found = stash(contaminated(docs, benchmark).select("doc_id", "h1", "h2").distinct())
    a, b = unused(docs, "h1", "h2")
    h1, h2 = text_hashes()
    mine = docs.withColumn(a, h1).withColumn(b, h2)
    leak = mine["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (mine[a] == found["h1"]) & (mine[b] == found["h2"])
    return mine.join(found, leak, "left_anti").drop(a, b)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of the benchmark, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h1", "h2")
