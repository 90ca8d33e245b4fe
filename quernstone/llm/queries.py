"""The operators' queries over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import crosspoly, ctxmix, mixture, nndescent, pieces, ppm, readability, runindex, simhash, sstable
from quernstone.llm.common import read


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.repeated_passages(read(spark, sf_dir, "documents")).select("doc_id", "start", "stop", "first")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.nearest_neighbours(read(spark, sf_dir, "embeddings"))


def op3_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify_languages(read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), pieces.model_of(spark))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(read(spark, sf_dir, "documents"))


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.select_mixture(read(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_groups(read(spark, sf_dir, "embeddings"))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctxmix.score(read(spark, sf_dir, "documents"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.extract_pages(read(spark, sf_dir, "pages"))


def op10_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.build_shards(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_repeated_passages, op2_nearest_neighbours, op3_ppm_language_id, op4_sentencepiece, op5_simhash_near_dedup, op6_source_mixture, op7_embedding_near_dedup, op8_context_mixing, op9_html_main_text, op10_sstable_shards)}
ORACLES: dict[str, str] = {"op6_source_mixture": mixture.mixture_sql()}
