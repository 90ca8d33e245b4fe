"""spark-submit main: inputs to a store, with a summary; exits with 1 if a file failed."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession

from quernstone import __version__
from quernstone.operators import runs
from quernstone.plans.pipeline import Config, Pipeline


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quernstone", description=__doc__)
    p.add_argument("inputs", nargs="+", help="files and folders")
    p.add_argument("-o", "--output", default="output")
    p.add_argument("--workers", type=int, default=0, help="partitions of the files; by default Spark's parallelism")
    p.add_argument("--split-chunks", action="store_true", help="also write each index document as JSON")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("quernstone").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "ERROR")
    config = Config.from_env()
    config.workers = a.workers or config.workers
    if a.split_chunks and not config.timestamp:
        config.timestamp = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    result = Pipeline(spark, config, store=a.output).process_batch(*a.inputs)
    s = result.summary().first()
    pages = result.documents.selectExpr("sum(size(pages))").first()[0] or 0
    print(f"{s['succeeded']} read, {s['failed']} failed; {pages} pages, {result.images.count()} images, {result.chunks.count()} chunks")
    for f in runs.failures(result.documents.selectExpr("path", "IF(error IS NULL, 'succeeded', 'failed') AS status", "error")).toLocalIterator():
        print(f"  {f['path']}: {f['error']}", file=sys.stderr)
    return int(s["failed"] > 0)


if __name__ == "__main__":
    sys.exit(main())
