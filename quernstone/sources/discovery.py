"""Which files to read.

``listed`` walks the inputs on the driver, as hidden names and empty files count too, and reads the bytes on the executors; ``scanned`` and
``streamed`` leave listing to Spark's binaryFile source, which is the one for large trees and object stores.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as X

EXTENSIONS = frozenset("." + e for e in "bmp conf csv doc docx eml epub htm html ini jpeg jpg log md odp ods odt pdf png ppt pptx rtf tif tiff txt webp xls xlsm xlsx".split())
FILES = "path string, content binary"


def walk(inputs: Iterable[str], extensions: frozenset[str] = EXTENSIONS) -> Iterator[Path]:
    """The supported files of each input in turn, a file or a folder with all below it; what is missing or unsupported warns. Nothing is taken out twice or once only."""
    for token in inputs:
        p = Path(token)
        if p.is_dir():
            yield from (f for f in p.rglob("*") if f.is_file() and f.suffix.lower() in extensions)
        elif p.suffix.lower() not in extensions:
            warnings.warn(f"{token}: not supported" if p.exists() else f"{token}: no such file or folder", stacklevel=2)
        elif not p.is_file():
            warnings.warn(f"{token}: no such file", stacklevel=2)
        else:
            yield p


def listed(spark: SparkSession, inputs: Iterable[str], extensions: frozenset[str] = EXTENSIONS, slices: int | None = None) -> DataFrame:
    """FILES of the inputs, on folders that all executors share."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"path": [path], "content": [Path(path).read_bytes()]}, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    paths = [(str(p.resolve()),) for p in walk(inputs, extensions)]
    rows = spark.createDataFrame(paths, "path string")
    return rows.repartition(slices or max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4))).mapInArrow(load, FILES)


def glob_of(extensions: Iterable[str]) -> str:
    """A listing filter that matches the extensions in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e.lstrip(".")) for e in sorted(extensions)) + "}"


def scanned(spark: SparkSession, *folders: str, extensions: frozenset[str] = EXTENSIONS) -> DataFrame:
    """FILES by binaryFile; it leaves out empty files and names that begin with a dot or an underscore."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob_of(extensions))
    return read.load(list(folders)).select(F.regexp_replace("path", r"\Afile:/+", "/").alias("path"), "content")


def named(files: DataFrame) -> DataFrame:
    """``files`` with file_name, base_name and file_type of the path."""
    p = F.col("path")
    return files.withColumns({"file_name": X.file_name(p), "base_name": X.base_name(p), "file_type": X.file_type(X.file_name(p))})
