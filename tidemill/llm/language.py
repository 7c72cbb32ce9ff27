"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent letter n-grams (1 to 3, inside words padded by a blank), ranked over all
documents learned from. A document's own most frequent n-grams are ranked alike, and its distance to a profile is the sum
over them of how far out of place each stands, an n-gram missing from the profile counting as far as possible.

Learning counts in each task, adds up in one shuffle of (language, n-gram) rows and keeps ``profile`` rows of a
language; scoring is one pass without a shuffle. Profiles are broadcast in blocks of at most ``max_langs`` languages with ``profile`` rows
each; more languages take more passes, each of which keeps what is nearest so far. The names of all languages reach the driver.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when nothing was
learned. Rows with a null language aren't learned from. Equal counts rank by n-gram, equal distances go to
the language first in order. Texts of any length are counted whole. Repeated rows count and are answered each on its own; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import discard, prepare, remainder, stash, widened, without
from tidemill.tables import table

PROFILE = 400
OWN = 400
MAX_LANGS = 1000
BLANK = 32
_SHIFT = 21  # bits of a code point
_CHARS = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Code point to its lower-case letter, or to a blank."""
    out = np.full(0x110000, BLANK, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low[0])
    return out


def letters(text: str) -> np.ndarray:
    """Letters in lower case, any run of other characters one blank, a blank at both ends."""
    cps = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    cps = _letters()[cps]
    blank = cps == BLANK
    return cps[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.int64)


def grams(chars: np.ndarray) -> np.ndarray:
    """All n-grams of 1 to 3 that stay inside a padded word, each as one integer."""
    one = chars[chars != BLANK]
    a, b = chars[:-1], chars[1:]
    two = (a << _SHIFT | b)
    tri = two[:-1] << _SHIFT | chars[2:]
    return np.concatenate((one, two, tri[chars[1:-1] != BLANK])) if len(chars) > 2 else one


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[at], np.diff(np.append(at, len(values)))


@dataclass
class Profiles:
    """A block of languages; ranks[g, l]: the place of gram g in language l, or ``profile`` if it has none."""

    langs: list[str]
    gram: np.ndarray
    ranks: np.ndarray
    profile: int
    own: int

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        chars = letters(text)
        if len(chars) < 3:
            return "und", 0.0
        key, n = counted(grams(chars))
        top = key[np.argsort(-n, kind="stable")[: self.own]]
        place = np.arange(len(top))
        at = np.minimum(np.searchsorted(self.gram, top), len(self.gram) - 1)
        known = self.gram[at] == top
        ranks = self.ranks[at]
        far = np.where(known[:, None] & (ranks < self.profile), np.abs(ranks - place[:, None]), self.profile)
        distance = np.minimum(far, self.profile).sum(0)
        best = int(np.argmin(distance))
        return self.langs[best], float(1.0 - distance[best] / (self.profile * len(top)))


def fit(docs: DataFrame, profile: int = PROFILE, own: int = OWN, max_langs: int = MAX_LANGS) -> list[Profiles]:
    """Profiles from all rows with a language, in blocks; ``text`` and ``lang`` are read."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                key, n = counted(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(key), np.int64))), pa.array(key), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = grams(letters(text))
                held.setdefault(lang, []).append(g)
                size += len(g)
                if size > 8 * _CHARS:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    rows = docs.select("lang", "text").where("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= profile).select("lang", "gram", F.col("place") - 1)
    top = stash(top.toDF("lang", "gram", "place"))
    every = sorted(r.lang for r in top.select("lang").distinct().collect())
    blocks = []
    for at in range(0, len(every), max_langs):
        langs = every[at : at + max_langs]
        got = top.where(F.col("lang").between(langs[0], langs[-1])).toPandas()  # profile rows for each language of a block
        gram = np.sort(got["gram"].unique())
        ranks = np.full((len(gram), len(langs)), profile, np.int32)
        ranks[np.searchsorted(gram, got["gram"].to_numpy()), np.searchsorted(np.array(langs, object), got["lang"].to_numpy())] = got["place"].to_numpy()
        blocks.append(Profiles(langs, gram, ranks, profile, own))
    discard(top)
    return blocks


def identify(docs: DataFrame, profiles: list[Profiles]) -> DataFrame:
    """Adds lang_pred and score to the given columns, in place of any so named."""
    spark = prepare(docs.sparkSession)
    docs = without(docs, "lang_pred", "score")
    names = docs.columns
    at = names.index("text")
    out = docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    for n, block in enumerate(profiles):
        shared = spark.sparkContext.broadcast(block)

        def predicted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for text, lang, score in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                    here = shared.value.predict(text)
                    found.append(here if lang == "und" or here[1] > score else (lang, score))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*names, "lang_pred", "score"])

        out = (stash(out) if n else out).mapInArrow(predicted, widened(docs, "lang_pred string, score double"))
    return out


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned from ids whose crc32 mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    profiles = fit(docs.where(remainder(5) != 0))
    out = identify(docs.select("doc_id", (remainder(5) == 0).alias("held_out"), "text"), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")
