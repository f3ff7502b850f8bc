"""Tables that a plan reads more than once."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, worked out once: written to the shared folder that spark.checkpoint.dir names and read
    again, which a lost executor does not touch; in a session without one, kept by the executors."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{root.rstrip('/')}/corpusmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
