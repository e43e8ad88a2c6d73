"""Caches with times to live, as versioned tables of (section, key, value, ts), looked up as of now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.versions import VersionedTable, newest

VERSION = "v3"
SCHEMA = "section string, key string, value string, ts bigint"
_HOUR = 3_600_000
#: How long entries of each section live, in milliseconds; sections that never expire are absent.
TTL_MS = {"html": 12 * _HOUR, "price": 12 * _HOUR, "keywords": 24 * _HOUR, "search": 168 * _HOUR, "errors": _HOUR // 6}


def table(spark: SparkSession, path: str) -> VersionedTable:
    """The cache as one row for each section and key, changed under its readers."""
    return VersionedTable(spark, f"{path}/{VERSION}", SCHEMA, ("section", "key"))


def put(entries: DataFrame, path: str, errors: bool = False) -> None:
    """Set entries; the last one of a key counts. Empty keyword results are not kept, and errors only if asked for: a run's caller decides how long they last."""
    kept = entries.where("not (section = 'keywords' and value in ('', '[]'))").where(F.lit(errors) | (F.col("section") != "errors"))
    table(entries.sparkSession, path).upsert(kept.select("section", "key", "value", "ts"), newest(["section", "key"], ["ts"]))


def _alive(rows: DataFrame, now_ms: int) -> DataFrame:
    ttl = F.create_map(*[F.lit(x) for kv in TTL_MS.items() for x in kv])
    return rows.where(F.try_element_at(ttl, F.col("section")).isNull() | (F.col("ts") + F.try_element_at(ttl, F.col("section")) >= now_ms))


def live(spark: SparkSession, path: str, now_ms: int) -> DataFrame:
    """The entry of each key, if it is still alive."""
    return _alive(table(spark, path).read(), now_ms)


def compact(spark: SparkSession, path: str, now_ms: int) -> None:
    """Leave out the entries that have expired; readers of the version before keep theirs, writers in between lose nothing."""
    cached = table(spark, path)
    expired = cached.read().join(live(spark, path, now_ms).select("section", "key"), ["section", "key"], "left_anti")
    cached.upsert(expired, lambda old, _: _alive(old, now_ms))


def clear(spark: SparkSession, path: str) -> None:
    table(spark, path).clear()
