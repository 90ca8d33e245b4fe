"""What earlier runs and other programs left: chunk files, logos, and the files of a folder as a Spark data source."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quernstone.operators import chunking
from quernstone.sources import discovery, pixels

META = "struct<total_txt_chunks_on_pg:int,num_rows:int,num_col:int,img_id:string,img_path:string>"
CHUNKS_FILE = f"_header struct<file_path:string,file_name:string,total_pgs:int>, chunks array<struct<chunk_id:string,chunk_type:string,pg_num:int,chunk_idx:int,content:string,token_cnt:int,metadata:{META},embedding:array<float>>>"
LOGO_TYPES = (".png", ".jpg", ".jpeg", ".bmp", ".gif", ".tiff")


def chunk_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Chunks of JSON files that hold a header and a list, with the header's fields beside each; a file is read whole by one task."""
    rows = spark.read.schema(CHUNKS_FILE).option("multiLine", "true").json(list(paths))
    return rows.select("_header.*", F.explode("chunks").alias("c")).select("file_path", "file_name", "total_pgs", "c.*")


def index_chunk_files(spark: SparkSession, *paths: str, timestamp: str, skip_empty: bool = True) -> DataFrame:
    """Index documents of chunk files, as of a run's own chunks."""
    rows = chunk_files(spark, *paths).withColumn("doc_id", F.col("file_path"))
    headers = rows.select("doc_id", "file_name", "file_path", "total_pgs").distinct()
    return chunking.index_documents(rows.drop("file_path", "file_name", "total_pgs"), headers, timestamp, skip_empty)


def shrunk(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``shrunk``: an image's content that still repeats itself."""
    from quernstone.functions import text as X

    return chunks.withColumn("shrunk", (F.col("chunk_type") == "image") & (F.length(X.drop_echo(F.col("content"))) < F.length("content")))


def logos(folder: str) -> list[tuple[str, list[int]]]:
    """(name, hash) of the pictures in a folder in the order of their names; what can't be read is left out, a folder that isn't there is empty."""
    if not Path(folder).is_dir():
        return []
    found = ((p.name, pixels.features(p.read_bytes())["phash"]) for p in sorted(Path(folder).iterdir()) if p.suffix.lower() in LOGO_TYPES)
    return [(n, h) for n, h in found if h]


class _Path(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.inputs = [x for x in options.get("path", "").split(",") if x]
        self.slices = int(options.get("slices", "64"))

    def partitions(self) -> list[InputPartition]:
        paths = [str(p.resolve()) for p in discovery.walk(self.inputs)]
        n = max(1, min(self.slices, len(paths)))
        return [_Path(paths[i::n]) for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            yield path, Path(path).read_bytes()


class FileSource(DataSource):
    """``spark.read.format("quernstone_files").load("folder,other.txt")`` gives path and content; empty and hidden files count."""

    @classmethod
    def name(cls) -> str:
        return "quernstone_files"

    def schema(self) -> str:
        return discovery.FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSource)
