"""Shared helpers: written intermediate tables, and vectorised word hashing inside tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text hashed at once inside a task; bounds the working arrays.
SLICE_BYTES = 1 << 20
#: Partitions that blocks of vectors are dealt over, at most; more blocks share partitions.
MOST_PARTITIONS = 20_000

#: The bytes that separate words, 0x20 and 0x09 to 0x0D.
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE_BYTES, _BASE_WORDS, _BASE_WORDS_2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Only a local session may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own_dir()
    return found.rstrip("/")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/marketloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system for ``path``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table written to ``path`` and read back: cuts lineage and survives lost executors."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder."""
    return stored(df, scratch_path(df.sparkSession, name))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    hadoop, fs = file_system(spark, path)
    fs.delete(hadoop, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once its results are written elsewhere."""
    remove(spark, _scratch_root(spark))


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_names(columns: Iterable[str], *made: str) -> list[str]:
    """``columns`` but those called as one of ``made``, in any case: Spark tells no two such names apart."""
    taken = {m.lower() for m in made}
    return [c for c in columns if c.lower() not in taken]


def vector_rows(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one length as a matrix of doubles (of longs for whole numbers)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.int64 if flat.dtype.kind in "iu" else np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def same_length(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The vectors of the most frequent length (the greatest of several), and how many they are."""
    found = vectors.groupBy(F.size(column).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return (vectors.where(F.size(column) == found["size"]), found["n"]) if found else (vectors, 0)


def least_hashes(rows: DataFrame, key: str, n_rows: int, limit: int) -> DataFrame:
    """Of ``n_rows`` rows those with low hashes of ``key``, about twice ``limit``: a limit in order of hashes then moves these alone.

    All rows if there are few, or if a repeated key leaves fewer than ``limit`` under the bound.
    """
    if n_rows <= 8 * limit:
        return rows
    bound = -(2**63) + int(2**64 * 2 * limit / n_rows)
    low = rows.where(F.xxhash64(key) < bound)
    return low if low.limit(limit).count() == limit else rows


def met(rows: DataFrame, queries: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """Rows and queries with equal ``keys`` brought together in about ``blocks`` partitions, a group's rows before its queries.

    A row is moved once; only queries are copied. A group's queries stream past its rows, so however many they are,
    a task holds one block of rows.
    """
    both = rows.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    least = 3 * rows.sparkSession.sparkContext.defaultParallelism  # few rows still mean much work
    return both.repartition(max(least, min(blocks, MOST_PARTITIONS)), *keys).sortWithinPartitions(*keys, "asks")


def meetings(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    """Each group's rows with its queries, at most ``size`` of these at a time, from batches sorted by ``met``."""
    current, rows, block = None, [], None
    for batch in batches:
        sorted_by = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (*keys, "asks")], 1)
        edge = [0, *(np.flatnonzero((sorted_by[1:] != sorted_by[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge[:-1], edge[1:]):
            if a == b:
                continue
            *key, asks = sorted_by[a].tolist()
            if key != current:
                current, rows, block = key, [], None
            if not asks:
                rows.append(batch.slice(a, b - a))
            elif rows:
                block = block if block is not None else pa.Table.from_batches(rows)
                for lo in range(a, b, size):
                    yield block, batch.slice(lo, min(size, b - lo))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near values land far apart."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=8)
def _powers(base: int, log2: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log2
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, b in ((up, base), (down, pow(base, -1, 1 << 64))):
        out[0] = 1
        filled = 1
        while filled < n:  # doubling: the next block is this block times base**filled
            out[filled : 2 * filled] = out[:filled] * U64(pow(b, filled, 1 << 64))
            filled *= 2
    return up, down


def _prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, max(10, int(len(values)).bit_length()))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def runs_hash(values: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """A hash of each run of ``k`` consecutive values; empty if there are fewer."""
    if len(values) < k:
        return np.empty(0, np.uint64)
    sums, down = _prefix(values, _BASE_WORDS_2 if second else _BASE_WORDS)
    return mix((sums[k:] - sums[:-k]) * down[: len(values) - k + 1])


class Words:
    """Words of consecutive documents: hashes, byte spans, and the first word of each document."""

    __slots__ = ("hashes", "starts", "ends", "first", "n_docs", "data", "base")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.base = int(offsets[0])
        raw = data[self.base : int(offsets[-1])]
        self.data = raw
        at = (offsets - self.base).astype(np.int64)
        self.n_docs = len(at) - 1
        inside = np.ones(len(raw) + 2, bool)
        inside[1:-1] = SEPARATORS[raw]
        left, here, right = inside[:-2], ~inside[1:-1], inside[2:]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        self.starts = np.flatnonzero(here & (left | edge[:-1]))
        self.ends = np.flatnonzero(here & (right | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, at)
        sums, down = _prefix(_BYTE_VALUES[_LOWER[raw] if lower else raw], _BASE_BYTES)
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without making Python strings; nulls count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about SLICE_BYTES each; a longer document stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
