"""Language-model scores by prediction by partial matching over bytes, beside a unigram base score.

Text is scored in a canonical form: A-Z in lower case, words joined by one space, a line end as end mark. The model is a trie of byte
contexts up to ``ORDER`` bytes, counted over all documents learned from. A symbol that follows its longest known
context has probability (c - 1/2) / total; otherwise the model escapes (method D) with 1/2 * distinct / total
to the next shorter context, where every symbol seen in the longer one is excluded; below the empty context all bytes
left are equal. Counts of shorter contexts follow the update-exclusion rule: an n-gram counts once for each different byte
before it. As a context's symbols are among those of its suffixes, what is to be excluded is one number for each context.

The trie grows with the corpus, so it's neither cut nor broadcast: every n-gram counted stays. An n-gram is kept `turned`, its context read
backwards and then its symbol, so that a context of any length is one stretch of the order, and the order is cut into shards at
contexts of ``ORDER`` bytes. Only the contexts that are an end of a cut (``ORDER`` for each cut, the `spine`) lie in several
shards; their symbols are summed over all shards and handed to the shards on both sides, so each shard is a whole trie for
the contexts in it. The base score needs the count of every word; words are dealt over shards by a hash.

What travels is packed: tasks send each shard one row of sorted n-grams (or words) with counts, and blocks of documents send each shard
one row of their distinct n-grams (or words) and get one row of log probabilities (or counts) back, so a hot word or n-gram is one
entry of a task or block. Shards are as many as the corpus has stretches of ``SHARD_BYTES``, ``MAX_SHARDS`` at most, and are copied where
blocks ask more of one than a task should answer. What the driver holds is a sample of n-grams that places the cuts, and the spine.

Cases: a null or empty text is its end mark alone. Rows that repeat are scored one by one. A text of any length is one block. With nothing to
learn from the base score is 0 and bytes are equally likely. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import ctypes
import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import prepare, remainder, stash
from tidemill.tables import table

ORDER = 6
SHARD_BYTES = 16 << 20
MAX_SHARDS = 4096
SHARD_ASKED = 8_000_000
MOST_PARTITIONS = 50_000
SAMPLE_BYTES = 8 << 20
PAD = b"\t" * ORDER
END = b"\n"
BLOCK_BYTES = 12 << 20
BLOCK_DOCS = 1 << 14
_CHUNK = 2 << 20
_STEP = 1 << 16
_SCORED = 1 << 20
_FLUSH = 2 << 20
_HEADER = np.dtype([("doc", "<i8"), ("null", "?"), ("held", "?"), ("length", "<i8")])


def canonical(texts: pa.Array) -> tuple[pa.ListArray, pa.Array]:
    """Words of each text, and the bytes that the model sees: words joined by a space, then END and a pad. A null text has no words."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words = pc.ascii_split_whitespace(plain)
    return words, pc.binary_join_element_wise(pc.binary_join(words, " "), (END + PAD).decode(), "")


def word_values(words: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All words, and how many each text has; the one empty word of an empty text isn't counted."""
    values = words.flatten()
    filled = pc.not_equal(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    count = np.diff(words.offsets.to_numpy())
    if not filled.all():
        count = np.add.reduceat(np.append(filled, False).astype(np.int64), words.offsets.to_numpy()[:-1]) * (count > 0)
        values = values.filter(pa.array(filled))
    return values, count


def _release() -> None:
    """Give memory of earlier tasks or batches back to the system; a Python worker would hold on to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _extent(strings: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets of strings that lie one after another (the first at 0), and their bytes."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64) if len(strings) else np.zeros(1, np.int64)
    data = memoryview(strings.buffers()[2])[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else memoryview(b"")
    return offsets - offsets[0], data


def turned_keys(raw: bytes | memoryview, at: int, upto: int) -> np.ndarray:
    """For each byte of raw[at:upto], the ORDER bytes before it read backwards and then itself, as one integer."""
    buffer = (PAD if at < ORDER else b"") + bytes(raw[max(0, at - ORDER) if at >= ORDER else 0 : upto]) + b"\0"
    start = 0 if at >= ORDER else at
    seen = np.ndarray((upto - at,), "<i8", buffer, offset=start, strides=(1,))  # eight bytes from each byte on, the first one lowest
    out = np.empty(upto - at, np.int64)
    for i in range(0, len(out), _STEP):  # pieces that stay in the cache
        x = seen[i : i + _STEP]
        out[i : i + _STEP] = (x & (1 << 8 * ORDER) - 1) << 8 | (x >> 8 * ORDER) & 0xFF
    return out


def _tally(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs (or the sum of its n)."""
    if n is None:
        keys = np.sort(keys)
    elif len(keys) and (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], (np.diff(np.append(at, len(keys))) if n is None else np.add.reduceat(n, at) if len(at) else n)


def _distinct_grams(raw: bytes | memoryview) -> np.ndarray:
    """Distinct turned n-grams of canonical texts, in order."""
    parts = [np.zeros(0, np.int64)]
    for at in range(0, len(raw), _CHUNK):
        keys = turned_keys(raw, at, min(len(raw), at + _CHUNK))
        parts.append(_tally(keys[keys & 0xFF != PAD[0]])[0])
    return _tally(np.concatenate(parts))[0]


def word_shards(words: pa.Array, number: int) -> np.ndarray:
    """The shard of each word, by a hash of its bytes; words aren't empty."""
    offsets, data = _extent(words)
    if not len(words):
        return np.zeros(0, np.int64)
    size = np.diff(offsets)
    powers = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    weighed = (np.frombuffer(data, np.uint8) + np.uint64(1)) * powers[np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)]
    h = np.add.reduceat(weighed, offsets[:-1])
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(number)).astype(np.int64)


def _squeeze(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte, compressed."""
    return pa.compress(np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(numbers) else b""


def _unsqueeze(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).reshape(-1).view(np.int64)


def _frame(*parts: bytes) -> bytes:
    """Parts in one value."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parts(framed: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(framed):
        size = int.from_bytes(framed[at : at + 8], "little")
        out.append(framed[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _pack_grams(turns: np.ndarray, n: np.ndarray | None = None) -> bytes:
    """Sorted n-grams as differences, and their counts, if given."""
    return _frame(len(turns).to_bytes(8, "little"), _squeeze(np.diff(turns, prepend=0)), *([] if n is None else [_squeeze(n)]))


def _unpack_grams(packed: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    size, turns, *n = _parts(packed)
    length = int.from_bytes(size, "little")
    return np.cumsum(_unsqueeze(turns, length)), _unsqueeze(n[0], length) if n else None


def _pack_words(words: pa.Array, n: np.ndarray | None = None) -> bytes:
    """Words (which hold no white space) on lines, and their counts, if given."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_buffer()
    return _frame(len(words).to_bytes(8, "little"), len(joined).to_bytes(8, "little"), pa.compress(joined, codec="zstd", asbytes=True), *([] if n is None else [_squeeze(n)]))


def _unpack_words(packed: bytes) -> tuple[pa.Array, np.ndarray | None]:
    size, length, joined, *n = _parts(packed)
    text = pa.decompress(joined, decompressed_size=int.from_bytes(length, "little"), codec="zstd", asbytes=True)
    whole = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(text)], np.int32)), pa.py_buffer(text)])
    words = pc.split_pattern(whole, "\n").flatten()
    return words, _unsqueeze(n[0], int.from_bytes(size, "little")) if n else None


def _shorter(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turned n-grams without the first byte of their text, and how many each came from."""
    return _tally(grams >> 16 << 8 | grams & 0xFF)


Spine = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def spine_of(cuts: list[int]) -> set[tuple[int, int]]:
    """(length, context turned) of the contexts that lie on both sides of a cut."""
    return {(k, cut >> 8 * (ORDER + 1 - k)) for cut in cuts for k in range(ORDER)}


def spine_counts(turns: np.ndarray, spine: set[tuple[int, int]]) -> Spine:
    """Symbols of a shard's spine contexts, counted from longer contexts that are no spine themselves."""
    out: Spine = {}
    grams = turns
    for k in range(ORDER - 1, -1, -1):
        grams, n = _shorter(grams)
        for c in [c for length, c in spine if length == k]:
            at, upto = np.searchsorted(grams, [c << 8, (c + 1) << 8])
            if upto > at:
                out[k, c] = (grams[at:upto] & 0xFF, n[at:upto])
                grams, n = np.delete(grams, np.s_[at:upto]), np.delete(n, np.s_[at:upto])
    return out


def resolved(parts: list[Spine]) -> Spine:
    """The spine's symbols and counts over all shards; a longer spine context counts once for each of its symbols."""
    sums: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(256, np.int64))
    for part in parts:
        for c, (symbols, n) in part.items():
            sums[c][symbols] += n
    for k in range(ORDER - 1, 0, -1):
        for c in [c for length, c in sums if length == k]:
            sums[k - 1, c >> 8] += sums[k, c] > 0
    return {c: (np.flatnonzero(n), n[np.flatnonzero(n)]) for c, n in sums.items()}


def _find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its place and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return at, sorted_[at] == keys


@dataclass
class Level:
    """Contexts of one length: turned n-grams and counts; contexts, their totals and numbers of symbols, and what their symbols count in the shorter context."""

    gram: np.ndarray
    count: np.ndarray
    ctx: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    below: np.ndarray


class Trie:
    """The model of a shard's contexts; levels[k] has those of k bytes."""

    def __init__(self, turns: np.ndarray, n: np.ndarray, spine: Spine | None = None) -> None:
        grams = {}
        for k in range(ORDER, -1, -1):
            if k < ORDER:
                turns, n = _shorter(turns)
                for c in [c for length, c in spine or () if length == k]:
                    at, upto = np.searchsorted(turns, [c << 8, (c + 1) << 8])
                    symbols, own = spine[k, c]
                    turns = np.concatenate((turns[:at], c << 8 | symbols, turns[upto:]))
                    n = np.concatenate((n[:at], own, n[upto:]))
            grams[k] = (turns, n)
        self.levels: list[Level] = []
        for k in range(ORDER + 1):
            gram, count = grams[k]
            ctx, start, distinct = np.unique(gram >> 8, return_index=True, return_counts=True)
            total = below = np.zeros(0, np.int64)
            if len(start):
                total = below = np.add.reduceat(count, start)
            if k and len(start):
                suffix, _ = _find(grams[k - 1][0], gram >> 16 << 8 | gram & 0xFF)
                below = np.add.reduceat(grams[k - 1][1][suffix], start)
            self.levels.append(Level(gram, count, ctx, total, distinct, below))

    def counted(self, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and context's total of each turned n-gram that was learned whole, 0 for others."""
        level = self.levels[ORDER]
        gram, seen = _find(level.gram, turns)
        context, _ = _find(level.ctx, turns >> 8)
        pick = lambda values, at: np.where(seen, values[at], 0) if len(values) else np.zeros(len(turns), np.int64)
        return pick(level.count, gram), pick(level.total, context)

    def log10(self, turns: np.ndarray) -> np.ndarray:
        """Log probability of each turned n-gram's symbol after its context; fastest in order."""
        out = np.zeros(len(turns))
        todo = np.arange(len(turns))
        longer = np.full(len(turns), -1, np.int64)  # place of the next longer context, where it is known
        for k in range(ORDER, -1, -1):
            level, keys = self.levels[k], turns[todo]
            context = keys >> 8 * (ORDER + 1 - k)
            at, known = _find(level.ctx, context)
            gram, seen = _find(level.gram, context << 8 | keys & 0xFF)
            total, distinct = np.where(known, level.total[at] if len(level.ctx) else 0, 0), np.where(known, level.distinct[at] if len(level.ctx) else 0, 0)
            after = np.flatnonzero(longer >= 0)
            if len(after):
                above = self.levels[k + 1]
                total[after] -= above.below[longer[after]]
                distinct[after] -= above.distinct[longer[after]]
            left = total > 0  # of what the longer context hasn't excluded
            weight = 0.5 * distinct
            weight[seen] = level.count[gram[seen]] - 0.5
            out[todo[left]] += np.log10(weight[left] / total[left])
            todo, longer = todo[~seen], np.where(known, at, -1)[~seen]
            if not len(todo):
                return out
        out[todo] -= np.log10(256 - len(self.levels[0].gram))
        return out


@dataclass
class Model:
    """Rows (shard, post) of the trie's shards and, after them, of the words'; cuts of the trie; tokens, distinct ones and end marks learned."""

    rows: DataFrame
    cuts: np.ndarray
    shards: int
    tokens: int
    distinct: int
    ends: int


def _gathered(columns: Iterator[pa.Array], least: int) -> Iterator[pa.Array]:
    """The texts of all columns, cut into arrays of about ``least`` bytes; a longer text is an array of its own."""
    held: list[pa.Array] = []
    size = 0
    for column in columns:
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(column):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + least - size, side="right")))
            held.append(column.slice(at, upto - at))
            size += int(ends[upto - 1] - (ends[at - 1] if at else 0))
            at = upto
            if size >= least or at < len(column):
                yield pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def _cuts(docs: DataFrame, size: int, shards: int, sample_bytes: int) -> np.ndarray:
    """Contexts that cut the order of n-grams into about equal parts of what a block of documents asks; a sample of documents places them."""
    if shards == 1:
        return np.zeros(0, np.int64)
    share = max(1, size // sample_bytes)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(share)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _gathered((b.column(0) for b in batches), _CHUNK):
            grams = _distinct_grams(_extent(canonical(texts)[1])[1])
            yield pa.RecordBatch.from_arrays([pa.array(grams[(grams * 0x9E3779B97F4A7C1 >> 40) % 16 == 0])], ["turn"])

    turns = np.unique(some.mapInArrow(run, "turn long").toArrow()["turn"].to_numpy())
    return np.unique(turns[len(turns) * np.arange(1, shards) // shards] & ~0xFF) if len(turns) else np.zeros(0, np.int64)


def fit(docs: DataFrame, shard_bytes: int = SHARD_BYTES, max_shards: int = MAX_SHARDS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of all n-grams and words of docs; doc_id and text are read."""
    spark = prepare(docs.sparkSession)
    ends, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = min(max_shards, max(1, -(-size // shard_bytes)))
    cuts = _cuts(docs, size, shards, sample_bytes)
    shards = len(cuts) + 1
    shared = spark.sparkContext.broadcast(cuts)  # one number for each shard

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        tallies: list[pa.Table] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(number: np.ndarray, posts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(posts, pa.binary())], ["shard", "post"])

        def flush_words(least: int) -> Iterator[pa.RecordBatch]:
            merged = pa.concat_tables(tallies).group_by("word").aggregate([("n", "sum")]) if tallies else pa.table({"word": [], "n_sum": []})
            tallies.clear()
            if len(merged) <= least:
                tallies.append(merged.rename_columns({"n_sum": "n"}))
                return
            words, n = merged["word"].combine_chunks(), merged["n_sum"].to_numpy()
            for s, here in _by_shard(word_shards(words, shards)):
                yield rows(np.array([shards + s]), [_pack_words(words.take(pa.array(here)), n[here])])

        def flush_grams() -> Iterator[pa.RecordBatch]:
            turns, n = parts.pop()
            at = np.concatenate(([0], np.searchsorted(turns, shared.value), [len(turns)]))
            some = np.flatnonzero(np.diff(at))
            yield rows(some, [_pack_grams(turns[at[i] : at[i + 1]], n[at[i] : at[i + 1]]) for i in some])

        for texts in _gathered((b.column(0) for b in batches), _CHUNK):
            words, wholes = canonical(texts)
            found = pc.value_counts(word_values(words)[0])
            tallies.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            if sum(map(len, tallies)) > 3 * _FLUSH // 4:
                yield from flush_words(_FLUSH // 4)
            raw = _extent(wholes)[1]
            for at in range(0, len(raw), _CHUNK):
                keys = turned_keys(raw, at, min(len(raw), at + _CHUNK))
                parts.append(_tally(keys[keys & 0xFF != PAD[0]]))
                if sum(len(p[0]) for p in parts) > 3 * _FLUSH // 2:
                    parts[:] = [_merged(parts)]
                    if len(parts[0][0]) > _FLUSH:
                        yield from flush_grams()
        if parts:
            parts[:] = [_merged(parts)]
            yield from flush_grams()
        yield from flush_words(0)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        now, parts, tallies = None, [], []

        def tallied() -> pa.Table:
            return pa.concat_tables(tallies).group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})

        def done() -> pa.RecordBatch:
            if now < shards:
                turns, n = _merged(parts)
                spine = spine_counts(turns, spine_of(shared.value[max(0, now - 1) : now + 1].tolist()))
                row = (now, len(turns), int(n.sum()), _pack_grams(turns, n), pickle.dumps(spine))
            else:
                whole = tallied()
                n = whole["n"].to_numpy()
                row = (now, len(n), int(n.sum()), _pack_words(whole["word"].combine_chunks(), n), None)
            parts.clear()
            tallies.clear()
            _release()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "size", "total", "post", "spine"])

        for batch in batches:
            for shard, post in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now:
                    if now is not None:
                        yield done()
                    now = shard
                if shard < shards:
                    parts.append(_unpack_grams(post.as_py()))
                    if sum(len(p[0]) for p in parts) > max(_FLUSH, 2 * len(parts[0][0])):
                        parts[:] = [_merged(parts)]
                else:
                    words, n = _unpack_words(post.as_py())
                    tallies.append(pa.table({"word": words, "n": n}))
                    if sum(map(len, tallies)) > max(_FLUSH // 2, 2 * len(tallies[0])):
                        tallies[:] = [tallied()]
        if now is not None:
            yield done()

    counted = docs.select("text").mapInArrow(count, "shard long, post binary")
    dealt = _dealt(counted, 2 * shards, "shard").sortWithinPartitions("shard")
    held = stash(dealt.mapInArrow(merge, "shard long, size long, total long, post binary, spine binary"))
    spark.sparkContext._jvm.System.gc()  # Spark removes a shuffle's files once nothing refers to it, and a small driver heap may not be collected for long
    words, tokens = held.where(F.col("shard") >= shards).agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    rows = held.select("shard", F.lit(-1).cast("long").alias("block"), "post")
    if shards > 1:
        parts = [pickle.loads(r.spine) for r in held.where("spine is not null").select("spine").collect()]  # ORDER contexts of 256 symbols at most on each side of a cut
        spine = resolved(parts)
        own = [(i, -2, bytearray(pickle.dumps({c: spine[c] for c in spine_of(cuts[max(0, i - 1) : i + 1].tolist()) if c in spine}))) for i in range(shards)]
        rows = rows.unionByName(spark.createDataFrame(own, "shard long, block long, post binary"))
    return Model(rows, cuts, shards, tokens + ends, words + (ends > 0), ends)


def _dealt(df: DataFrame, groups: int, key: str) -> DataFrame:
    """Repartitioned by the key; over more partitions than usual where there are more groups, as each is a few MB and much work."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(key) if groups <= usual else df.repartition(min(groups, MOST_PARTITIONS), key)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return parts[0] if len(parts) == 1 else _tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places it has, in order."""
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], shard[order][1:] != shard[order][:-1], [True]))) if len(shard) else np.zeros(1, np.int64)
    for i, j in zip(at[:-1], at[1:], strict=True):
        yield int(shard[order[i]]), order[i:j]


def _blocks(docs: DataFrame) -> DataFrame:
    """block, header (a document's id, split and length each) and compressed canonical texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        task = TaskContext.get().partitionId()
        number = 0
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            docs_ = pa.Table.from_batches(held).combine_chunks()
            offsets, raw = _extent(canonical(docs_["text"].combine_chunks())[1])
            header = np.zeros(len(docs_), _HEADER)
            header["doc"] = pc.fill_null(docs_["doc_id"], 0).to_numpy()
            header["null"] = docs_["doc_id"].is_null().to_numpy()
            header["held"] = docs_["held_out"].to_numpy()
            header["length"] = np.diff(offsets)
            cols = [pa.array([task << 24 | number], pa.int64()), pa.array([header.tobytes()], pa.binary()), pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["block", "header", "text"])

        size = rows = 0
        for batch in batches:
            ends = np.cumsum(pc.add(pc.fill_null(pc.binary_length(batch.column(2)), 0), 1).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                upto = min(max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES - size, side="right"))), at + BLOCK_DOCS - rows, batch.num_rows)
                held.append(batch.slice(at, upto - at))
                size, rows, at = size + int(ends[upto - 1] - base), rows + upto - at, upto
                if size >= BLOCK_BYTES or rows >= BLOCK_DOCS or at < batch.num_rows:
                    yield flush()
                    number += 1
                    held.clear()
                    size = rows = 0
                    _release()
        if held:
            yield flush()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "block long, header binary, text binary")


def _opened(header: bytes, text: bytes | pa.Buffer) -> tuple[np.ndarray, memoryview]:
    """A block's documents and its canonical texts, one after another."""
    docs = np.frombuffer(header, _HEADER)
    return docs, memoryview(pa.decompress(text, decompressed_size=int(docs["length"].sum()), codec="zstd"))


def _block_words(docs: np.ndarray, raw: memoryview, shards: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct words, their shards, the number of each word in the text, and how many words each document has."""
    offsets = np.concatenate(([0], np.cumsum(docs["length"]))).astype(np.int32)
    values, count = word_values(canonical(pa.Array.from_buffers(pa.string(), len(docs), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]))[0])
    found = values.dictionary_encode()
    return found.dictionary, word_shards(found.dictionary, shards), found.indices.to_numpy(), count


def _answers(packed: DataFrame, model: Model, blocks: int, asked: int) -> DataFrame:
    """(block, shard, post): what each shard answers to a block, in the order of what the block asked."""
    spark = packed.sparkSession
    shared = spark.sparkContext.broadcast(model.cuts)
    shards = model.shards
    copies = max(1, int(np.ceil(blocks * (BLOCK_BYTES / 8) / shards / asked)))  # about an eighth of a block's bytes are distinct n-grams

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        for batch in batches:
            for block, header, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                docs, raw = _opened(header.as_py(), text.as_buffer())
                turns = _distinct_grams(raw)
                at = np.concatenate(([0], np.searchsorted(turns, shared.value), [len(turns)]))
                some = np.flatnonzero(np.diff(at))
                posts = [(i, _pack_grams(turns[at[i] : at[i + 1]])) for i in some.tolist()]
                del turns
                words, shard, _, _ = _block_words(docs, raw, shards)
                posts += [(shards + s, _pack_words(words.take(pa.array(here)))) for s, here in _by_shard(shard)]
                copy = block % copies
                yield pa.RecordBatch.from_arrays([pa.array([i * copies + copy for i, _ in posts], pa.int64()), pa.array([block] * len(posts), pa.int64()), pa.array([p for _, p in posts], pa.binary())], ["key", "block", "post"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        now, trie, spine, held, waiting, size = None, None, {}, None, [], 0

        def words_answered() -> Iterator[pa.RecordBatch]:
            """Many blocks at a time, as each look-up lays out the shard's words anew."""
            nonlocal size
            if waiting:
                sought = [w for _, w in waiting]
                at = pc.index_in(pa.concat_arrays(sought), value_set=held[0]) if held else pa.nulls(sum(map(len, sought)), pa.int32())
                n = np.append(held[1] if held else np.zeros(0, np.int64), 0)[pc.fill_null(at, len(held[0]) if held else 0).to_numpy()]
                ends = np.cumsum([0, *map(len, sought)])
                for (block, _), i, j in zip(waiting, ends[:-1], ends[1:], strict=True):
                    yield reply(block, _squeeze(n[i:j]))
                waiting.clear()
                size = 0

        def reply(block: int, post: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([now // copies], pa.int64()), pa.array([post], pa.binary())], ["block", "shard", "post"])

        for batch in batches:
            for key, block, post in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key != now:
                    yield from words_answered()
                    now, trie, spine, held = key, None, {}, None
                    _release()
                post = post.as_py()
                if key // copies >= shards:
                    if block == -1:
                        held = _unpack_words(post)
                    else:
                        waiting.append((block, _unpack_words(post)[0]))
                        size += len(waiting[-1][1])
                        if size > 1 << 20:
                            yield from words_answered()
                elif block == -2:
                    spine = pickle.loads(post)
                elif block == -1:
                    held = _unpack_grams(post)
                else:
                    if trie is None:
                        trie = Trie(*(held or (np.zeros(0, np.int64), np.zeros(0, np.int64))), spine)
                    yield reply(block, _pack_logs(trie, _unpack_grams(post)[0]))
        yield from words_answered()

    asking = packed.mapInArrow(ask, "key long, block long, post binary")
    own = model.rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select((F.col("shard") * copies + F.col("copy")).alias("key"), "block", "post")
    dealt = _dealt(own.unionByName(asking), 2 * shards * copies, "key").sortWithinPartitions("key", "block")  # a shard comes before what is asked of it
    return dealt.mapInArrow(answer, "block long, shard long, post binary")


def _pack_logs(trie: Trie, turns: np.ndarray) -> bytes:
    """Log probabilities; those of n-grams learned whole as two small numbers."""
    n, total = trie.counted(turns)
    return _frame(len(turns).to_bytes(8, "little"), _squeeze(n), _squeeze(total), pa.compress(trie.log10(turns[n == 0]).tobytes(), codec="zstd", asbytes=True) if not n.all() else b"")


def _unpack_logs(packed: bytes) -> np.ndarray:
    size, n, total, others = _parts(packed)
    n, total = (_unsqueeze(x, int.from_bytes(size, "little")) for x in (n, total))
    out = np.log10(np.maximum(n - 0.5, 0.5) / np.maximum(total, 1))
    new = n == 0
    if new.any():
        out[new] = np.frombuffer(pa.decompress(others, decompressed_size=8 * int(new.sum()), codec="zstd", asbytes=True))
    return out


def _summed(raw: memoryview, lengths: np.ndarray, turns: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log probabilities of a block's documents from those of its distinct n-grams."""
    out = np.zeros(len(lengths))
    starts = np.cumsum(lengths) - lengths
    for at in range(0, len(raw), _SCORED):
        upto = min(len(raw), at + _SCORED)
        keys = turned_keys(raw, at, upto)
        # Sorted by the most recent context bytes with the place below them, searches stay in the cache.
        order = (np.sort((keys.view(np.uint64) >> np.uint64(16) << np.uint64(24)) | np.arange(len(keys), dtype=np.uint64)) & np.uint64(0xFFFFFF)).astype(np.int64)
        wanted = keys[order]
        place, there = _find(turns, wanted)
        each = np.zeros(len(keys))
        each[order] = np.where(there, logs[place], 0.0)  # a pad is no symbol, and isn't among the n-grams
        first, stop = np.searchsorted(starts, at, side="right") - 1, np.searchsorted(starts, upto, side="left")
        out[first:stop] += np.add.reduceat(each, np.maximum(starts[first:stop] - at, 0))
    return out


def score(docs: DataFrame, model: Model, asked: int = SHARD_ASKED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; docs has doc_id, held_out and text."""
    prepare(docs.sparkSession)
    packed = stash(_blocks(docs))
    blocks = packed.count()
    shards, tokens, ends = model.shards, model.tokens, model.ends
    floor = float(np.log10(tokens + model.distinct + 1))
    own = [packed.select("block", F.lit(part).cast("long").alias("shard"), F.col(name).alias("post")) for part, name in ((-2, "header"), (-1, "text"))]
    back = own[0].unionByName(own[1]).unionByName(_answers(packed, model, blocks, asked))

    def gather(t: pa.Table) -> pa.Table:
        order = np.argsort(t["shard"].to_numpy(), kind="stable")
        shard, posts = t["shard"].to_numpy()[order].tolist(), t["post"].take(pa.array(order)).to_pylist()
        docs, raw = _opened(posts[0], posts[1])
        answers = list(zip(shard[2:], posts[2:], strict=True))
        logs = [_unpack_logs(p) for s, p in answers if s < shards]
        scores = _summed(raw, docs["length"], _distinct_grams(raw), np.concatenate(logs))
        words, of, number, count = _block_words(docs, raw, shards)
        n = np.zeros(len(words), np.int64)
        for s, here in _by_shard(of):
            n[here] = _unsqueeze(next(p for t, p in answers if t == shards + s), len(here))
        each = np.append(n[number], 0)
        starts = np.minimum(np.cumsum(count) - count, len(each) - 1)
        base = np.where(count > 0, np.add.reduceat(np.log10(each + 1.0), starts), 0.0) + np.log10(ends + 1.0)
        known = np.where(count > 0, np.add.reduceat((each > 0).astype(np.int64), starts), 0) + (ends > 0)
        total = count + 1
        _release()
        cols = [pa.array(docs["doc"].astype(np.int64), mask=docs["null"]), pa.array(docs["held"]), pa.array(total, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(docs), tokens, np.int64)), pa.array(base - total * floor), pa.array(scores)]
        return pa.Table.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _dealt(back, blocks, "block").groupBy("block").applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned from ids whose crc32 mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(7) == 2).alias("held_out"), "text")
    return score(docs, fit(docs.where("not held_out")))
