"""Numbers, stops and percentiles of groups of any size, with one key that holds nine tenths of the rows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import ranks


def table(spark, n=20_000):
    rnd = random.Random(2)
    rows = [("hot" if k % 10 else rnd.choice(["a", "b", None]), rnd.randint(0, 3000), k, rnd.random() < 0.01) for k in range(n)]
    return rows, spark.createDataFrame(rows, "key string, at int, id int, hit boolean").repartition(6)


@pytest.fixture(params=[100_000, 0], ids=["broadcast", "shuffled"])
def spans(request, monkeypatch):
    monkeypatch.setattr(ranks, "BROADCAST_SPANS", request.param)


def test_numbers_and_batches(spark, spans):
    rows, df = table(spark)
    want, seen = {}, defaultdict(int)
    for key, _, at, _ in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        seen[key] += 1
        want[at] = seen[key]
    got = {r.id: r.row_no for r in ranks.numbered(df, ["key"], [F.col("at"), F.col("id")]).collect()}
    assert got == want
    down = {r.id: r.batch_no for r in ranks.batches(df, ["key"], [F.col("at").desc(), F.desc("id")], 7).collect()}
    assert down == {k: (seen[key] - want[k]) // 7 for key, _, k, _ in rows}


def test_no_task_takes_a_hot_key_alone(spark):
    _, df = table(spark)
    lined = ranks.lined_up(df, ["key"], [F.col("at"), F.col("id")])
    per_span = sorted(r["n"] for r in lined.groupBy("span_").agg(F.count("*").alias("n")).collect())
    assert len(per_span) >= 8 and per_span[-1] <= 2 * per_span[len(per_span) // 2]
    out = ranks.numbered(df, ["key"], [F.col("at"), F.col("id")]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
    per_task = sorted(r["n"] for r in out.collect())
    assert per_task[-1] <= 2 * per_task[len(per_task) // 2]


@pytest.mark.parametrize("batch,enough", [(10, 5), (1, 3), (100, 1)])
def test_stops(spark, spans, batch, enough):
    rows, df = table(spark)
    groups = defaultdict(list)
    for key, at, k, hit in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        groups[key].append((k, hit))
    want = {}
    for own in groups.values():
        for n, (k, _) in enumerate(own):
            before = sum(h for _, h in own[: n // batch * batch])
            if before < enough:
                want[k] = (n // batch, before)
            else:
                break
    got = {r.id: (r.batch_no, r.hits_before) for r in ranks.progressive_stop(df, ["key"], [F.col("at"), F.col("id")], F.col("hit"), batch, enough).collect()}
    assert got == want


def test_percentiles(spark, spans):
    rnd = random.Random(6)
    rows = [("hot", rnd.choice([rnd.randint(1, 1000), rnd.randint(1, 10**6)])) for _ in range(5000)] + [("few", 5), ("few", 5), ("few", 9), ("one", 7), (None, 4), (None, 8), ("none", None), ("none", -1)]
    rows += [("four", x) for x in (1, 2, 3, 100)]
    df = spark.createDataFrame(rows, "key string, price long").repartition(5)
    groups = defaultdict(set)
    for key, price in rows:
        if price and price > 0:
            groups[key].add(price)
    got = {r.key: r for r in ranks.price_summary(df, ["key"]).collect()}
    assert got.keys() == groups.keys()
    outliers = defaultdict(set)
    for r in ranks.price_outliers(df, ["key"]).collect():
        outliers[r.key].add(r.outlier_price)
    for key, values in groups.items():
        v = sorted(values)
        q1, q2, q3 = (float(np.percentile(v, p)) for p in (25, 50, 75))
        kept = v if len(v) < 4 else [x for x in v if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
        r = got[key]
        assert (r.n_distinct, r.n_kept, r.min_price, r.max_price) == (len(v), len(kept), kept[0], kept[-1])
        assert (r.p25, r.p50, r.p75) == pytest.approx((q1, q2, q3))
        assert (r.avg_price, r.median_price) == (round(sum(kept) / len(kept)), round(float(np.median(kept))))
        assert outliers[key] == set(v) - set(kept)
    assert ranks.price_summary(df.where("false"), ["key"]).count() == 0
