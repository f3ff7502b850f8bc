"""Token counts through a digest cache.

A text's normalised content (null is empty; nothing else may change, as byte-level tokens see every
byte) and the tokenizer's own digest name a row of a Parquet cache. Digests without a row are
encoded once each, at the document with the least id among those that share them, and their counts
are appended to the cache; documents then take their counts from it. Copies therefore cost a digest,
and a second run over the same cache encodes nothing.

The cache is a folder of the shared file system that the caller names and keeps (shared_cache is a
place for it); without one a new folder is made and the run encodes every distinct text. Each run
adds a table of its own within it, so that runs at once do not disturb one another; only counts are
stored, so a digest that two of them add is harmless: the reader takes one.

Null texts are empty. Rows that repeat an id, or have none, are counted each. An empty table gives
no rows and an empty cache. Only id and text are read; other columns and their names do not matter."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh_path, map_batches, materialize, shared_root, text_or_empty, write_once
from corpusmill.llm.encoding import TokenCounts

LIMIT = 512
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def shared_cache(spark) -> str:
    """The place of a cache that all sessions over one shared folder use."""
    return f"{shared_root(spark)}/corpusmill-token-cache"


def read_cache(spark, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", "true").parquet(cache)
    except Exception as e:  # a cache that no run has written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, cache: str | None = None, tokenizer: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. Without a cache given, a new
    one is made, so that every distinct text is encoded."""
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    version = tokenizer_version(tokenizer)
    cache = cache or fresh_path(spark, "token-cache")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    digest = F.unhex(F.sha2(F.col("text"), 256)).alias("digest")
    known = materialize(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest), "token-digests")
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("digest")
    # the null id sorts first in a least, so it is replaced by a number no document has
    least = F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("at")
    misses = known.join(stored, "digest", "left_anti").groupBy("digest").agg(least).select("at").distinct()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounts(tokenizer, ranks)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([version] * len(texts), pa.string()), pa.array(list(map(count, texts)), pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    fresh = texts.join(misses.hint("shuffle_hash"), F.coalesce("doc_id", F.lit(-(2**63))) == F.col("at"), "left_semi").select("text")
    write_once(map_batches(fresh, encode, CACHE_SCHEMA), f"{cache}/{uuid.uuid4().hex}")
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return known.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
