"""Token counts through a digest cache.

``token_counts`` joins the digest of each text, with the tokenizer's version digest, to a table of stored counts.
Only distinct digests that the table lacks are encoded, once each, and appended to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import scratch_path
from marketloom.llm.encoders import BYTE_BPE, byte_encoder, tokenizer_path

CACHE_SCHEMA = "text_digest binary, version string, n_tokens bigint"


def tokenizer_version(name: str = BYTE_BPE, folder: str | None = None) -> str:
    """Digest of the vocabulary file: another file can never meet counts stored for this one."""
    with open(tokenizer_path(name, folder), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored counts; a cache that was never written is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path).dropDuplicates(["text_digest", "version"])


def _counter(folder: str | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(folder)
        for batch in batches:
            counts = [len(encoder.encode(x)) // 4 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("text_digest"), pa.array(counts, pa.int64())], ["text_digest", "n_tokens"])

    return count


def token_counts(docs: DataFrame, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, folder: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_tokens, over_limit.

    The digest is SHA-256 of the text's UTF-8 bytes, a null text counting as empty: the tokenizer tells apart every
    two texts that differ, so no further normalisation is sound. Repeated rows each get a row; null ids are kept;
    empty texts have 0 tokens; an empty table gives no rows; other columns of ``docs`` are not read.
    Copies are combined before the shuffle, so a text held by a third of all rows is one row from each task.
    """
    spark = docs.sparkSession
    version = tokenizer_version(folder=folder)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    digested = base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_digest"))
    known = read_cache(spark, cache_path).where(F.col("version") == version)
    misses = (
        base.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_digest"), "text")
        .groupBy("text_digest")
        .agg(F.first("text").alias("text"))
        .join(known.select("text_digest"), "text_digest", "left_anti")
    )
    fresh = misses.mapInArrow(_counter(folder), "text_digest binary, n_tokens bigint")
    fresh.select("text_digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    stored = read_cache(spark, cache_path).where(F.col("version") == version).select("text_digest", "n_tokens")
    return digested.join(stored, "text_digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def new_cache(spark: SparkSession) -> str:
    return scratch_path(spark, "token-cache")
