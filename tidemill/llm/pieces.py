"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

At each position the automaton's output links give every piece that ends there; each relaxes the best score
of its end from the best score of its start. A character that no piece covers is spelled in byte pieces, as the model asks.
Of equal scores the segmentation whose last piece is longer wins, at each position.

Scores must be log probabilities for their sums to mean anything. A unigram model's are taken as they are. A BPE model's are minus the rank
of the merge, so its pieces get log probabilities by a fixed rule instead, nothing being trained: Zipf's law in Mandelbrot's form over the ranks,
1 / (rank + ``OFFSET``), as merges are ranked by how frequent they were. Other types of model, and models whose normaliser would change a
text, are refused. User-defined pieces win outright: a text is cut at them (the longest, from the left) before anything else.

A piece holds the space mark only as its first characters, which is checked when a model is loaded, so best segmentations of
the parts of a text between spaces join up to the best one of the text; parts that repeat are looked up. The model
file is read once on the driver by path, its pieces (a fixed vocabulary) are broadcast, and executors need no file. One
pass, no shuffle.

Cases: a null text gives null ids, an empty one an empty list. Special pieces (<s>, </s>, <unk>) in a text are spelled as ordinary text. The
space mark itself in a text (U+2581) becomes a space when decoded, as in the original scheme; ``exact`` is false for
such a text and true for every other. Repeated rows are encoded one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import prepare, widened, without
from tidemill.tables import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
OFFSET = 100
_MEMO = 300_000


def _fields(raw: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield number, kind, value


def ranked_scores(scores: list[float], kinds: list[int], offset: int = OFFSET) -> list[float]:
    """Log probabilities by Zipf's law of pieces whose scores only rank them; other kinds keep their score."""
    ranked = sorted((i for i, k in enumerate(kinds) if k == NORMAL), key=lambda i: (-scores[i], i))
    weight = 1.0 / (np.arange(1, len(ranked) + 1) + offset)
    out = list(scores)
    for i, p in zip(ranked, np.log(weight / weight.sum()).tolist() if ranked else [], strict=True):
        out[i] = p
    return out


@dataclass
class Vocabulary:
    """Pieces, log probabilities and kinds by id; whether a space is put before the text."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    prefix: bool = True

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            raw = f.read()
        pieces, scores, kinds, prefix, type_ = [], [], [], True, UNIGRAM
        for number, _, value in _fields(raw):
            got = {n: v for n, _, v in _fields(value)} if number in (1, 2, 3) else {}
            if number == 1:
                pieces.append(got.get(1, b"").decode())
                scores.append(float(np.frombuffer(got[2], "<f4")[0]) if 2 in got else 0.0)
                kinds.append(got.get(3, NORMAL))
            elif number == 2:
                type_ = got.get(3, UNIGRAM)
            elif number == 3:
                prefix = bool(got.get(3, 1))
                if got.get(2) or got.get(4, 1):
                    raise ValueError("the model's normaliser changes texts; only models that keep them as they are can be used")
        if type_ not in (UNIGRAM, BPE):
            raise ValueError(f"model type {type_}: only unigram and BPE models have pieces to segment by")
        return cls(pieces, scores if type_ == UNIGRAM else ranked_scores(scores, kinds), kinds, prefix)


class _Words(dict):
    """Ids of words that follow one space, found when first asked for; ``inexact`` has those that don't decode to themselves."""

    def __init__(self, coder: Coder) -> None:
        self.coder = coder
        self.inexact: set[str] = set()

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = self.coder.viterbi(MARK + word)
        if len(self) >= _MEMO:
            self.clear()
        if self.coder.raw(got) != (MARK + word).encode("utf-8", "surrogatepass"):
            self.inexact.add(word)
        elif len(word) <= 64:
            self[word] = got
        return got


@dataclass
class Coder:
    """Encodes and decodes with one vocabulary."""

    vocabulary: Vocabulary
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.automaton = ahocorasick.Automaton()
        self.byte_ids = {}
        for i, (piece, score, kind) in enumerate(zip(v.pieces, v.scores, v.kinds, strict=True)):
            if kind == NORMAL and piece:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} holds a space mark after other characters")
                self.automaton.add_word(piece, (i, len(piece), score))
            elif kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
        self.automaton.make_automaton()
        self.user_ids = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == USER and p}
        self.user = re.compile("|".join(map(re.escape, sorted(self.user_ids, key=len, reverse=True)))) if self.user_ids else None
        self.words = _Words(self)
        self.lowest = min(v.scores, default=0.0) - 10.0
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode() for p, k in zip(v.pieces, v.kinds, strict=True)]

    def spell(self, char: str) -> list[int]:
        if not self.byte_ids:
            return [self.vocabulary.kinds.index(UNKNOWN)]
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")]

    def viterbi(self, part: str) -> tuple[int, ...]:
        """Best segmentation of one part, in a single pass over the automaton."""
        n = len(part)
        none = float("-inf")
        best, step, piece = [none] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        filled = 0  # up to here, positions that no piece ends at are reached by spelling their character
        lowest = self.lowest
        for last, (i, size, score) in self.automaton.iter(part):
            while filled < last:
                filled += 1
                alone = best[filled - 1] + lowest
                if alone > best[filled]:
                    best[filled], step[filled], piece[filled] = alone, 1, -1
            end = last + 1
            total = best[end - size] + score
            if total > best[end] or (total == best[end] and size > step[end]):
                best[end], step[end], piece[end] = total, size, i
        for at in range(filled + 1, n + 1):
            alone = best[at - 1] + lowest
            if alone > best[at]:
                best[at], step[at], piece[at] = alone, 1, -1
        out: list[int] = []
        at = n
        while at:
            size, i = step[at], piece[at]
            if i >= 0:
                out.append(i)
            else:
                out.extend(reversed(self.spell(part[at - 1])))
            at -= size
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if self.vocabulary.prefix:
            marked = MARK + marked
        if self.user is None:
            return self._encode(marked)
        out, at = [], 0
        for m in self.user.finditer(marked):
            out += [*self._encode(marked[at : m.start()]), self.user_ids[m[0]]]
            at = m.end()
        return out + self._encode(marked[at:])

    def _encode(self, marked: str) -> list[int]:
        out: list[int] = []
        memo = self.memo
        runs = 0  # marks that come before the next word
        for n, word in enumerate(marked.split(MARK)):
            runs += n > 0
            if word:
                part = MARK * runs + word
                got = memo.get(part)
                if got is None:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    got = self.viterbi(part)
                    if len(part) <= 64:
                        memo[part] = got
                out.extend(got)
                runs = 0
        if runs:
            out.extend(self.viterbi(MARK * runs))
        return out

    def checked(self, text: str) -> tuple[list[int], bool]:
        """The ids, and whether they decode to the text.

        Bytes of pieces are joined when decoding, so a text of single spaces decodes to itself if its words do.
        """
        words = text.split(" ")
        if not self.vocabulary.prefix or self.user is not None or "" in words or MARK in text:
            ids = self.encode(text)
            return ids, self.decode(ids) == text
        self.words.inexact.clear()
        ids = list(chain.from_iterable(map(self.words.__getitem__, words)))
        return ids, not self.words.inexact

    def raw(self, ids: list[int] | tuple[int, ...]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        text = self.raw(ids).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.vocabulary.prefix and text.startswith(" ") else text


_CODERS: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """One coder for a Python worker, so that what it has looked up serves later tasks too."""
    found = _CODERS.get(shared._jid if hasattr(shared, "_jid") else id(shared))
    if found is None:
        _CODERS.clear()
        found = _CODERS[shared._jid if hasattr(shared, "_jid") else id(shared)] = Coder(shared.value)
    return found


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds ids, n_tokens and exact (the ids decode to the text) to the given columns."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary)
    docs = without(docs, "ids", "n_tokens", "exact")
    names = docs.columns
    at = names.index("text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            flat, ends, null, same = [], [0], [], []
            for text in batch.column(at).to_pylist():
                ids, exact = ([], None) if text is None else coder.checked(text)
                null.append(text is None)
                same.append(exact)
                flat.append(np.array(ids, np.int32))
                ends.append(ends[-1] + len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)), mask=pa.array(null, pa.bool_()))
            count = pa.array(np.diff(ends), pa.int64(), mask=np.array(null, bool))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, count, pa.array(same, pa.bool_())], [*names, "ids", "n_tokens", "exact"])

    return docs.mapInArrow(encoded, widened(docs, "ids array<int>, n_tokens long, exact boolean"))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the text of a column of ids; null ids give a null text."""
    spark = prepare(encoded.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary)
    encoded = without(encoded, text)
    names = encoded.columns
    at = names.index(ids)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, text])

    return encoded.mapInArrow(decoded, widened(encoded, f"`{text}` string"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents, and whether they decode to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, Vocabulary.load(MODEL)).drop("text")
