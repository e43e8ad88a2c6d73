"""The cache as streaming state: equal to the lookup over whole tables, in slices, over a restart, and with nothing left behind."""

import random

from pyspark.sql import functions as F

from marketloom.operators import relational
from marketloom.streaming import cache_state as C

TTL = 3_600_000_000


def rows(n=400):
    rnd = random.Random(4)
    out = []
    for k in range(n):
        asks = rnd.random() < 0.6
        out.append((rnd.choice(["a", "b", "c", None]), rnd.randint(1, 60) * 600_000_000, asks, k if asks else None, None if asks else f"v{rnd.randint(0, 30):02d}"))
    return out


def looked_up(spark, data):
    df = spark.createDataFrame(data, "key string, t long, asks boolean, request_id long, value string")
    requests = df.where("asks").select("request_id", "key", F.col("t").alias("at"))
    cache = df.where("NOT asks").select("key", F.col("t").alias("written_at"), "value")
    return df, {r.request_id: r.value for r in relational.ttl_lookup(requests, cache, ["key"], TTL).collect()}


def test_a_replay_equals_the_lookup(spark):
    df, want = looked_up(spark, rows())
    got = C.replay(df, TTL, slices=2).collect()
    assert {r.request_id: r.value for r in got} == want and len(got) == len(want)
    assert any(want.values()) and not all(want.values())


def test_a_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    df, want = looked_up(spark, rows())
    source, target, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    half = 30 * 600_000_000
    timed = df.withColumn("seen", F.timestamp_micros("t"))
    timed.where(F.col("t") < half).write.parquet(f"{source}/0")
    C.answer(spark, source, target, checkpoint, TTL).awaitTermination()
    first = spark.read.parquet(target).count()
    assert 0 < first == sum(r[2] and r[1] < half for r in rows())
    C.answer(spark, source, target, checkpoint, TTL).awaitTermination()  # nothing new: nothing answered again
    assert spark.read.parquet(target).count() == first
    timed.where(F.col("t") >= half).write.parquet(f"{source}/1")
    C.answer(spark, source, target, checkpoint, TTL).awaitTermination()
    assert {r.request_id: r.value for r in spark.read.parquet(target).collect()} == want
    timed.limit(1).selectExpr("'z' AS key", f"{200 * 600_000_000} AS t", "true AS asks", "999L AS request_id", "CAST(NULL AS string) AS value", f"timestamp_micros({200 * 600_000_000}) AS seen").write.parquet(f"{source}/2")
    C.answer(spark, source, target, checkpoint, TTL).awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint)
    assert state.count() == 0  # the watermark has passed all lives
