"""A cache as streaming state: each key's newest entry, forgotten after its time to live.

``remembered`` keeps what ``relational.ttl_lookup`` works out over whole tables: entries and requests come as one stream
in order of time, and each request is answered from the state. In event time a timer forgets an entry once the
watermark has passed its life; in processing time Spark's own state TTL does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from marketloom.session import scratch

INPUT = "key string, t bigint, asks boolean, request_id bigint, value string, seen timestamp"
ANSWERS = "request_id bigint, value string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CacheProcessor(StatefulProcessor):
    """State of a key: its newest entry. Rows of one micro-batch are taken in order of time, entries before requests."""

    def __init__(self, ttl_us: int, by_event_time: bool):
        self.ttl_us, self.by_event_time = ttl_us, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        life = {} if self.by_event_time else {"ttl_duration_ms": self.ttl_us // 1000}
        self.newest = handle.getValueState("newest", "value string, written_at bigint", **life)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["t", "asks", "value"], kind="stable")
        before = self.newest.get() if self.newest.exists() else None
        values, times = batch["value"].to_numpy(dtype=object), batch["t"].to_numpy(np.int64)
        asks = batch["asks"].to_numpy(bool)
        if before is not None:
            values, times, asks = np.r_[[before[0]], values].astype(object), np.r_[before[1], times], np.r_[False, asks]
        newest = np.maximum.accumulate(np.where(~asks, np.arange(len(asks)), -1))
        # an entry that comes late, written before one that is known, does not replace it
        for k in np.flatnonzero(~asks[1:] & (times[1:] < times[0]) & (before is not None)) + 1:
            newest[newest == k] = 0
        found = (newest >= 0) & (times - times[newest] <= self.ttl_us)
        ids = batch["request_id"].to_numpy(dtype=object)
        offset = len(asks) - len(ids)
        answers = [(int(ids[k - offset]), values[newest[k]] if found[k] else None) for k in np.flatnonzero(asks)]
        last = newest[-1]
        if last >= 0 and (before is None or last > 0):
            self.newest.update((values[last], int(times[last])))
            if self.by_event_time:
                self.handle.registerTimer(int(times[last] + self.ttl_us) // 1000 + 1)
        if answers:
            yield pd.DataFrame(answers, columns=["request_id", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the timer of an entry that a later one has replaced finds that one alive
        if self.newest.exists() and (self.newest.get()[1] + self.ttl_us) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def remembered(stream: DataFrame, ttl_us: int, by_event_time: bool = True, late: str = "0 seconds") -> DataFrame:
    """(request_id, value) for each request of a stream of ``INPUT`` rows: entries (key, t, value) and requests (key, t, request_id).

    Times are microseconds after 1970. A request gets the newest entry of its key up to its time, no older than ``ttl_us``, or null;
    of entries written at one time the greatest value counts; a null key finds nothing and keeps nothing. An entry that
    arrives after a request was answered does not change the answer. The session must use the RocksDB state store.
    """
    timed = stream.withWatermark("seen", late)
    none = timed.where("key IS NULL AND asks").select("request_id", F.lit(None).cast("string").alias("value"))
    answered = timed.where("key IS NOT NULL").groupBy("key").transformWithStateInPandas(
        CacheProcessor(ttl_us, by_event_time), outputStructType=ANSWERS, outputMode="Append", timeMode="EventTime" if by_event_time else "ProcessingTime"
    )
    return answered.unionByName(none)


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def answer(spark: SparkSession, source: str, target: str, checkpoint: str, ttl_us: int) -> StreamingQuery:
    """Answer what has newly arrived in ``source`` (folders of Parquet files of ``INPUT``) as one micro-batch, from the checkpoint on.

    A micro-batch's rows of one key are in a task's memory at once; a source that runs on would bound them by maxBytesPerTrigger.
    """
    with_state_store(spark)
    out = remembered(spark.readStream.schema(INPUT).parquet(f"{source}/*"), ttl_us)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replay(rows: DataFrame, ttl_us: int, slices: int = 3) -> DataFrame:
    """``INPUT`` rows without ``seen``, arriving in slices of time, each answered by a run that starts from the checkpoint: (request_id, value)."""
    spark = rows.sparkSession
    seen = rows.withColumn("seen", F.timestamp_micros("t"))
    cuts = sorted({int(c) for c in seen.approxQuantile("t", [k / slices for k in range(1, slices)], 0.01)})
    source, target, checkpoint = (scratch(spark, name) for name in ("arrivals", "answers", "answers-checkpoint"))
    for k, (low, high) in enumerate(zip([-(2**63), *cuts], [*cuts, 2**63 - 1])):
        seen.where((F.col("t") >= low) & (F.col("t") < high)).write.parquet(f"{source}/{k}")
        answer(spark, source, target, checkpoint, ttl_us).awaitTermination()
    return spark.read.schema(ANSWERS).parquet(target)
