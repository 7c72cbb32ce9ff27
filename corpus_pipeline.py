"""A corpus pipeline: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a frame that is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. Columns of the input with clashing names are kept by the first
four stages, whatever they are called. No stage drops a row with null text: it has nothing to reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontaminate, neardup, pieces, secrets, toxicity
from tidemill.llm.common import stash
from tidemill.tables import table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, learned from all labels, doesn't reject."""
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.rejected_removed(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id. Of rows equal in doc_id and text, one."""
    return neardup.representatives(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact(docs, secrets.own_model(spark))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their pieces."""
    return pieces.encode(docs, pieces.Vocabulary.load(pieces.MODEL))


STAGES = [
    ("toxicity", toxic),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", leaks),
    ("secret_scan", redacted),
    ("sentencepiece_encoding", encoded),
]

#: Forests, factorization machines and sketches aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
