"""files -> documents, pages, images -> vision -> chunks -> index documents, as one lazy graph of DataFrames."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone import providers
from quernstone.functions import text as X
from quernstone.operators import chunking, images, runs
from quernstone.sinks import Store
from quernstone.sources import discovery, formats


@dataclass
class Config:
    """What a run can be told, also by QUERNSTONE_<NAME> in the environment; blank or malformed values there are ignored."""

    target_tokens: int = chunking.TARGET
    overlap_tokens: int = chunking.OVERLAP
    embed_chars: int = 8000
    min_side: int = images.MIN_SIDE
    workers: int = 0
    skip_existing: bool = True
    full_path_key: bool = True
    timestamp: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        given = os.environ if env is None else env
        out = cls()
        for f in fields(cls):
            value = given.get("QUERNSTONE_" + f.name.upper(), "").strip()
            kind = type(getattr(out, f.name))
            if not value:
                continue
            try:
                setattr(out, f.name, value.lower() in ("1", "true", "yes") if kind is bool else kind(value))
            except ValueError:
                continue
        return out


@dataclass
class Result:
    documents: DataFrame
    images: DataFrame
    chunks: DataFrame
    degradations: DataFrame

    def headers(self) -> DataFrame:
        return self.documents.select(F.col("path").alias("doc_id"), "file_name", F.col("path").alias("file_path"), F.size("pages").alias("total_pgs"))

    def index_documents(self, timestamp: str, skip_empty: bool = True) -> DataFrame:
        return chunking.index_documents(self.chunks, self.headers(), timestamp, skip_empty)

    def summary(self) -> DataFrame:
        status = F.when(F.col("error").isNull(), "succeeded").otherwise("failed")
        return runs.batch_summary(self.documents.select("path", status.alias("status"), "error"))


class Pipeline:
    def __init__(self, spark: SparkSession, config: Config | None = None, vision: Callable[[], providers.VisionModel] | None = None, embedder: Callable[[], providers.Embedder] | None = None, store: str | None = None, references: list[tuple[str, list[int]]] | None = None):
        self.spark, self.config, self.vision, self.embedder, self.references = spark, config or Config.from_env(), vision, embedder, references
        self.store = Store(spark, store) if store else None

    def process_batch(self, *inputs: str) -> Result:
        """Files and folders; with a store, what it already has is left out. Addresses (scheme://...) are listed by Spark, local names by the driver. Config.workers: partitions of the files."""
        slices = self.config.workers or None
        remote, local = [i for i in inputs if "://" in i], [i for i in inputs if "://" not in i]
        parts = [discovery.listed(self.spark, local, slices=slices)] if local or not remote else []
        if remote:
            found = discovery.scanned(self.spark, *remote)
            parts.append(found.repartition(slices) if slices else found)
        return self.process_files(parts[0] if len(parts) == 1 else parts[0].union(parts[1]))

    def process(self, path: str) -> Result:
        return self.process_batch(path)

    def report(self, result: Result, on_progress: Callable[[str, str | None], None]) -> None:
        """Call ``on_progress(path, error)`` for each document as they come; what the callback raises is ignored."""
        for r in result.documents.select("path", "error").toLocalIterator():
            with contextlib.suppress(Exception):
                on_progress(r["path"], r["error"])

    def process_files(self, files: DataFrame) -> Result:
        """files (path, content). A file that can't be read is a document with an error.

        Each model is called once for each row: with a store the images, with their bytes, are written before the chunks are made, and the chunks before the result is given, and both are
        read back; without one they are kept on the executors' disks, and made again only where an executor is lost.
        """
        c = self.config
        if self.store:
            self.store.new_run()
        if self.store and c.skip_existing and (done := self.store.read("documents")) is not None:
            key = "path" if c.full_path_key else "base_name"
            files = runs.pending(discovery.named(files), done, key).select("path", "content")
        docs = formats.documents(files).persist(StorageLevel.DISK_ONLY)
        keep = self.store.put if self.store else lambda _, df: df.persist(StorageLevel.DISK_ONLY)
        rows = formats.images_of(docs, self.references, c.min_side).where("filter_reason = 'kept'")
        none = [F.lit(None).cast("string").alias(n) for n in ("caption", "ocr_text", "description", "error")]
        said = providers.analyzed(rows, self.vision) if self.vision else rows.select("doc_id", "image_id", *none)
        kept = images.with_vision(rows, said)
        if self.embedder:
            kept = kept.withColumn("embedding", providers.embedded(X.best_text(F.col("description"), F.col("caption")), self.embedder, c.embed_chars))
        kept = keep("images", kept)
        pages = images.attach_to_pages(formats.pages_of(docs), kept)
        known = kept.select("doc_id", F.col("image_id").alias("img_id"), "embedding").where(F.col("embedding").isNotNull()) if self.embedder else None
        chunks = chunking.chunk_pages(pages, c.target_tokens, c.overlap_tokens, known)
        if self.embedder:
            chunks = providers.embed_missing(chunks, self.embedder, c.embed_chars)
        chunks = keep("chunks", chunks)
        if self.store:
            stored = self.store.put("documents", docs.drop("images"))
            docs.unpersist()
            docs = stored
        result = Result(docs, kept, chunks, runs.degradations(kept, chunks, bool(self.vision), bool(self.embedder)))
        if self.store and c.timestamp:
            self.store.write_json("individual_chunks", result.index_documents(c.timestamp))
        return result


def run(spark: SparkSession, inputs: Iterable[str], **options) -> Result:
    return Pipeline(spark, **options).process_batch(*inputs)
