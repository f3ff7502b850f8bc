"""Run directories: sizes, the newest run of each name, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, url string, startedAt string, finishedAt string, pages array<struct<url:string,status:string,error:string,flags:array<string>>>"


def run_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(run, files, bytes) of each directory below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    run = F.regexp_extract("path", r"/([^/]+)/" + "(?:pages|clean|reports|sections|[^/]+$)", 1)
    return files.groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def newest_runs(runs: DataFrame) -> DataFrame:
    """Of (name, dir, ...) the last directory of each name."""
    return runs.groupBy("name").agg(F.max("dir").alias("dir"))


def manifests(texts: DataFrame) -> DataFrame:
    """Text parsed by the manifest's schema; null where it is no JSON."""
    return texts.select("*", F.from_json("text", MANIFEST, {"mode": "PERMISSIVE"}).alias("manifest"))
