"""Helpers that the training-data operators share: shared-folder tables and Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.arrow import SLICE_BYTES, SLICE_ROWS, slices  # noqa: F401

#: Temporary folders of sessions on one machine that name none, by application.
_LOCAL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session on this one
    machine (tests) may do without and gets a temporary folder; elsewhere its lack is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master, application = spark.sparkContext.master, spark.sparkContext.applicationId
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if application not in _LOCAL:
            _LOCAL[application] = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        root = _LOCAL[application]
    return root.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/corpusmill-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; results must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_once(df: DataFrame, path: str) -> None:
    """Write df as Parquet; its shuffle files, which nothing reads after that, go at once."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again."""
    path = fresh_path(df.sparkSession, name)
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(lambda batches: fn(slices(batches)), schema)


def crc_fold(col: str, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(col).cast("string")) % folds


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
