"""The corpus pipeline: language identification, near-dedup, repeated passages, mixture, encoding.

Rows with a NULL or empty text, or in none of the languages, end at the first stage. Rows with a NULL doc_id stay through the next two stages as they came, since nothing
can be held against them by identifier. Equal rows count as one document in the near-dedup and stay together. An empty table gives no rows. Columns beside those of documents are carried to the last stage,
which returns doc_id, ids, n_tokens, round_trip and library_agrees, a row for each copy the mixture takes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import mixture, pieces, ppm, runindex, simhash
from quernstone.llm.common import ensure_checkpoint_dir, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in one of the languages that the labelled rows hold."""
    return ppm.keep_identified(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that several documents hold stay in the first of these only."""
    return runindex.cut_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixture.apply_mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip, library_agrees of every document."""
    return pieces.encode(docs, pieces.model_of(spark))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identified),
    ("simhash_near_dedup", without_copies),
    ("repeated_passages", without_repeats),
    ("source_mixture", mixed),
    ("sentencepiece", encoded),
]
ORACLE_SQL: str | None = None


def _delete(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what one returns is written to the shared checkpoint folder and read again for the next, and deleted once that is written; the last one's input stays, as
    the result is read from it."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES[:-1]):
        at = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            _delete(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
