"""Token counts of sections: offset-mapped attribution of one encoding of the whole document.

A document is encoded once, so counts add up to what a model would be fed; sections are not encoded on their
own. The bytes of a byte-level token give its span; spans are joined to the sections' spans by searching
section starts. Rule for a token that crosses sections: it belongs to the section that holds most of its
bytes, of equals to the earlier one. Zero or more sections can so end up with no token.

``section_spans`` splits at line ends (a section keeps its own); any list of starts does. The ranks file is read once
on the driver by path and broadcast (a fixed vocabulary). One pass, no shuffle, one row out for each section.

Cases: a null or empty text is one section of no length, with no token. Repeated rows are counted one by one; other
columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import prepare
from tidemill.tables import table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def section_starts(raw: bytes) -> np.ndarray:
    """Byte offsets at which lines start; always 0 first, none at the very end."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate(([0], ends[ends < len(raw)]))


def attribute(token_bytes: np.ndarray, starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens owned by each section, and those of them that cross into another."""
    end = np.cumsum(token_bytes)
    begin = end - token_bytes
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.searchsorted(starts, end - 1, side="right") - 1
    stops = np.append(starts[1:], total)
    owner = first.copy()
    crossing = np.flatnonzero(last > first)
    for t in crossing:
        s = np.arange(first[t], last[t] + 1)
        held = np.minimum(stops[s], end[t]) - np.maximum(starts[s], begin[t])
        owner[t] = s[np.argmax(held)]
    return np.bincount(owner, minlength=len(starts)), np.bincount(owner[crossing], minlength=len(starts))


@lru_cache(2)
def _encoding(key: int, items: object) -> tuple[tiktoken.Encoding, np.ndarray]:
    ranks = items.value
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def count_sections(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens, n_crossing for each section of each row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(ranks)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoding(id(shared), shared)
        for batch in batches:
            sizes, cols = [], [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                starts = section_starts(raw)
                stops = np.append(starts[1:], len(raw))
                ids = np.array(encoding.encode_ordinary(text), np.int64) if text else np.zeros(0, np.int64)
                n, crossing = attribute(lengths[ids], starts, len(raw))
                lead = np.cumsum(np.append(0, (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))  # characters before each byte
                sizes.append(len(starts))
                for c, v in zip(cols, (np.arange(len(starts)), lead[starts], lead[stops], n, crossing), strict=True):
                    c.append(v)
            if sizes:
                ids_ = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([ids_, *[pa.array(np.concatenate(c).astype(np.int64)) for c in cols]], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    schema = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(counted, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return count_sections(table(spark, sf_dir, "documents"), load_ranks(RANKS))
