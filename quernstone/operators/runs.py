"""What a run skips, counts and reports; nearest vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as X


def pending(files: DataFrame, done: DataFrame, key: str = "base_name") -> DataFrame:
    """The files whose key isn't stored yet."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def unwritten(chunks: DataFrame, written: DataFrame) -> DataFrame:
    """The index documents (doc_name, id) without a file of their own yet."""
    return chunks.join(written.select("doc_name", "id").distinct(), ["doc_name", "id"], "left_anti")


def split_stats(outcomes: DataFrame) -> DataFrame:
    """outcomes (status, shrunk) -> created, skipped, failed, deduped."""
    n = lambda cond: F.count_if(cond)
    return outcomes.agg(*[n(F.col("status") == s).alias(s) for s in ("created", "skipped", "failed")], n(F.col("shrunk") & (F.col("status") == "created")).alias("deduped"))


def batch_summary(results: DataFrame) -> DataFrame:
    """results (path, status, error) -> succeeded, failed, skipped, total."""
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "skipped")], F.count(F.lit(1)).alias("total"))


def failures(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "failed").select("path", "error")


def degradations(images: DataFrame, chunks: DataFrame, vision: bool = True, embedder: bool = True) -> DataFrame:
    """(doc_id, stage, id, error): images a vision model failed on, images and chunks that an embedder left without a vector."""
    out = images.where(F.lit(vision) & F.col("error").isNotNull()).select("doc_id", F.lit("vision").alias("stage"), F.col("image_id").alias("id"), "error")
    if embedder:
        missing = F.lit("no vector")
        out = out.unionByName(images.where(F.col("embedding").isNull()).select("doc_id", F.lit("embed_image").alias("stage"), F.col("image_id").alias("id"), missing.alias("error")))
        out = out.unionByName(chunks.where(F.col("embedding").isNull()).select("doc_id", F.lit("embed_chunk").alias("stage"), F.col("chunk_id").alias("id"), missing.alias("error")))
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; NULL if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def top_similar(vectors: DataFrame, query: list[float], k: int = 5, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to a query vector by cosine; planned as a top-k, not a sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_column, cosine(F.col(column), q).alias("score")).where(F.col("score").isNotNull()).orderBy(F.desc("score"), id_column).limit(k)


def embeddable(c: Column, limit: int = 8000) -> Column:
    """What an embedder gets of a text: its first ``limit`` characters; NULL for a blank one."""
    return F.when(X.filled(c).rlike(X.NOT_WS), F.substring(c, 1, limit))
