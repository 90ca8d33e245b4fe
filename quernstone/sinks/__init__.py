"""The store: where a run's tables are kept, on any folder or address that Spark can write."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quernstone.operators import runs

PARTS = ("images", "chunks", "documents")
#: Folders of split index documents.
SHARDS = 64


def json_line(columns: list[str], vector: str = "content_vector") -> Column:
    """A row as JSON: fields that are NULL are left out, but for ``vector``, which comes last."""
    line = F.to_json(F.struct(*[F.col(c) for c in columns if c != vector]))
    if vector not in columns:
        return line
    last = F.concat(F.lit(f',"{vector}":'), F.coalesce(F.to_json(F.col(vector)), F.lit("null")), F.lit("}"))
    return F.concat(F.substring(line, F.lit(1), F.length(line) - 1), last)


class Store:
    """Tables below ``root``, a partition for each run. ``documents`` is written last: a document counts as done once it is there, so a run that broke off is taken up again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.run = spark, root.rstrip("/"), "r" + uuid.uuid4().hex

    def path(self, part: str) -> str:
        return f"{self.root}/{part}"

    def read(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path(part))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def put(self, part: str, df: DataFrame) -> DataFrame:
        """Write this run's rows of a part, and give them as read from there: what made them, a model's answers too, isn't made again."""
        at = f"{self.path(part)}/run={self.run}"
        df.write.mode("append").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def new_run(self) -> None:
        """Begin another partition."""
        self.run = "r" + uuid.uuid4().hex

    def save(self, images: DataFrame, chunks: DataFrame, documents: DataFrame) -> None:
        for part, df in zip(PARTS, (images, chunks, documents), strict=True):
            self.put(part, df)

    def write_json(self, name: str, docs: DataFrame) -> None:
        """Index documents as JSON lines in SHARDS folders by a hash of the document, and their identifiers as a table, so that what is there is known without reading the
        lines; content_vector stays where it is NULL, other kinds' fields don't."""
        line = json_line(docs.columns)
        shard = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int")
        docs.select(shard.alias("shard"), line.alias("value")).write.mode("append").partitionBy("shard").text(self.path(name))
        docs.select("doc_id", "id").write.mode("append").parquet(self.path(name + "_ids"))

    def split(self, name: str, docs: DataFrame, skip_existing: bool = True) -> DataFrame:
        """Write the index documents that aren't there yet and return the run's split_stats().

        What a task fails to write fails the job, so ``failed`` is 0 where there is a result. ``docs`` may carry ``shrunk``."""
        if "shrunk" not in docs.columns:
            docs = docs.withColumn("shrunk", F.lit(False))
        status = F.lit("created")
        if skip_existing and (old := self._written(name)) is not None:
            known = old.select(F.col("doc_name").alias("_doc"), F.col("id").alias("_id"))
            docs = docs.join(known, (F.col("doc_id") == F.col("_doc")) & (F.col("id") == F.col("_id")), "left")
            status = F.when(F.col("_id").isNull(), "created").otherwise("skipped")
        marked = docs.withColumn("status", status).drop("_doc", "_id").persist(StorageLevel.DISK_ONLY)
        stats = runs.split_stats(marked).collect()
        self.write_json(name, marked.where("status = 'created'").drop("status", "shrunk"))
        marked.unpersist()
        return self.spark.createDataFrame(stats)

    def _written(self, name: str) -> DataFrame | None:
        found = self.read(name + "_ids")
        return found if found is None else found.select(F.col("doc_id").alias("doc_name"), "id").distinct()


def upload(docs: DataFrame, make: Callable[[], Callable[[list[dict]], list[bool] | None]], batch: int = 500) -> DataFrame:
    """Send index documents to a search index and tell of each (id, status, error).

    make: called once in each task, gives what sends a list of documents and says of each whether it was taken, or None for all. A batch that raises is 'failed' with its error. Lazy: one action
    on the result sends everything once; a task that is run again sends its documents again, which an index keyed by id takes as the same.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = make()
        for frame in frames:
            rows = [json.loads(x) for x in frame["body"]]
            for at in range(0, len(rows), batch):
                part, error, taken = rows[at : at + batch], None, None
                try:
                    taken = send(part)
                except Exception as e:  # the batch's failure is its documents'
                    error, taken = f"{type(e).__name__}: {e}", [False] * len(part)
                taken = [True] * len(part) if taken is None else taken
                yield pd.DataFrame({"id": [r["id"] for r in part], "status": ["uploaded" if t else "failed" for t in taken], "error": error})

    body = F.to_json(F.struct(*docs.columns)).alias("body")
    return docs.select(body).mapInPandas(run, "id string, status string, error string")
