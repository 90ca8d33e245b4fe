"""Files that arrive: the chunk rules look at one document at a time, so the stream keeps no state but what it has read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators import chunking
from quernstone.sources import discovery, formats

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """FILES that appear below ``folder``."""
    read = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", discovery.glob_of(discovery.EXTENSIONS)).option("maxFilesPerTrigger", files_per_batch)
    return read.load(folder).select(F.regexp_replace("path", r"\Afile:/+", "/").alias("path"), "content")


def chunk_stream(files: DataFrame, target: int = chunking.TARGET, overlap: int = chunking.OVERLAP) -> DataFrame:
    return chunking.chunk_pages(formats.pages_of(formats.documents(files)), target, overlap)


def ingest(spark: SparkSession, folder: str, output: str, checkpoint: str, files_per_batch: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Append the chunks of new files to ``output``; ``checkpoint`` remembers which were read."""
    write = chunk_stream(arriving(spark, folder, files_per_batch)).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return (write.trigger(availableNow=True) if available_now else write).start()
