"""Numbers, stops and percentiles of groups of any size: one group may be many tasks.

Rows are sorted over the whole table by ranges of (key, order) and written once with their place. A range's rows of one
key are a span; the counts of spans before it say how many rows of the key come first. So a row's number within its key
is an offset of its span plus its place, and nothing is ever sorted or counted in one task for a key. Where a rank is
sought, only the span that holds it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import stored

#: Ranges for each shuffle partition, so that a frequent key's spans even out; spans that are broadcast at most (some 100 bytes each).
RANGES, BROADCAST_SPANS = 2, 100_000
_PLACE_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def _spans_met(lined: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with what is known of their span; broadcast only if the spans are few, which is counted."""
    few = spans.limit(BROADCAST_SPANS + 1).count() <= BROADCAST_SPANS
    return lined.join(F.broadcast(spans) if few else spans, ["key_", "span_"])


def lined_up(rows: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """``rows`` sorted by key and order over the whole table, written, with key_, span_ (its range) and place_ (in the range)."""
    spark = rows.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(c) for c in partition], *order]
    sorted_rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("place_", F.monotonically_increasing_id())
    kept = stored(sorted_rows, "lined")
    span, place = F.shiftrightunsigned("place_", _PLACE_BITS).cast("int"), F.col("place_").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return kept.select(*rows.columns, F.struct(*partition).alias("key_"), span.alias("span_"), place.alias("place_"))


def spans_of(lined: DataFrame) -> DataFrame:
    """(key_, span_, first_, offset_, n_): of each span its first place, the key's rows before it, and the key's rows in all."""
    counted = stored(lined.groupBy("key_", "span_").agg(F.min("place_").alias("first_"), F.count("*").alias("n")), "spans")
    before = Window.partitionBy("key_").orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key_")
    # a key has at most one span a range, so these groups are as small as the number of ranges
    return counted.select("key_", "span_", "first_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset_"), F.sum("n").over(whole).alias("n_"))


def numbered(rows: DataFrame, partition: list[str], order: list[Column], number: str = "row_no") -> DataFrame:
    """``rows`` with their number (from 1) within their key, in the given order; the order decides ties, null keys are one key."""
    lined = lined_up(rows, partition, order)
    met = _spans_met(lined, spans_of(lined))
    return met.select(*rows.columns, (F.col("offset_") + F.col("place_") - F.col("first_") + 1).alias(number))


def batches(rows: DataFrame, partition: list[str], order: list[Column], size: int) -> DataFrame:
    """Rows with the number of the flush that writes them, whatever the size of a group."""
    return numbered(rows, partition, order, "number_").withColumn("batch_no", F.floor((F.col("number_") - 1) / size).cast("int")).drop("number_")


def progressive_stop(rows: DataFrame, partition: list[str], order: list[Column], hit: Column, batch: int, enough: int) -> DataFrame:
    """Rows that are still looked at when work goes in batches and stops before the first batch with ``enough`` hits behind it.

    Of a key only its first ``enough`` hits matter, and each task keeps no more of them before the shuffle.
    """
    lined = lined_up(rows.withColumn("hit_", F.coalesce(hit, F.lit(False))), partition, order)
    spans = stored(spans_of(lined), "offsets")
    row_batch = F.floor((F.col("offset_") + F.col("place_") - F.col("first_")) / batch).cast("int")
    in_key = Window.partitionBy("key_").orderBy("span_", "place_")
    hits = lined.where("hit_").select("key_", "span_", "place_").withColumn("r_", F.row_number().over(in_key)).where(F.col("r_") <= enough)
    first_hits = _spans_met(hits, spans).select("key_", row_batch.alias("b_")).groupBy("key_").agg(F.array_sort(F.collect_list("b_")).alias("hits_"))  # ``enough`` at most
    known = spans.join(first_hits, "key_", "left")
    numbered_rows = _spans_met(lined, known).withColumn("batch_no", row_batch)
    seen = F.size(F.filter(F.coalesce("hits_", F.array().cast("array<int>")), lambda b: b < F.col("batch_no"))).cast("bigint")
    return numbered_rows.withColumn("hits_before", seen).where(F.col("hits_before") < enough).select(*rows.columns, "batch_no", "hits_before")


def _at_ranks(lined: DataFrame, spans: DataFrame, ranks: dict[str, Column], value: str) -> DataFrame:
    """Of each key the values at ranks (from 0, in terms of the spans' columns): only spans that hold one are met with rows."""
    end = Window.partitionBy("key_").orderBy("span_")
    bounded = spans.withColumn("end_", F.coalesce(F.lead("offset_").over(end), F.col("n_")))
    sought = bounded.withColumns({f"at_{k}": r for k, r in ranks.items()})
    holds = lambda k: (F.col(f"at_{k}") >= F.col("offset_")) & (F.col(f"at_{k}") < F.col("end_"))
    some = holds(next(iter(ranks)))
    for k in list(ranks)[1:]:
        some = some | holds(k)
    met = _spans_met(lined, sought.where(some))
    rank = F.col("offset_") + F.col("place_") - F.col("first_")
    return met.groupBy("key_").agg(*[F.max(F.when(rank == F.col(f"at_{k}"), F.col(value))).alias(k) for k in ranks])


def _interpolated(found: DataFrame, shares: dict[str, float], count: str) -> DataFrame:
    at = lambda p: F.lit(p) * (F.col(count) - 1)
    mixed = lambda k, p: F.col(f"{k}_lo") * (1 - (at(p) - F.floor(at(p)))) + F.col(f"{k}_hi") * (at(p) - F.floor(at(p)))
    return found.select("key_", count, *[mixed(k, p).alias(k) for k, p in shares.items()])


def _ends(shares: dict[str, float], count: str, start: Column) -> dict[str, Column]:
    at = lambda p: F.lit(p) * (F.col(count) - 1)
    return {f"{k}_{side}": start + f(at(p)) for k, p in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}


def _quartiles(observations: DataFrame, keys: list[str], price: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct prices (value_) lined up, their spans, and (key_, n_distinct, p25, p50, p75)."""
    distinct = observations.where(F.col(price) > 0).select(*keys, F.col(price).alias("value_")).distinct()
    lined = lined_up(distinct, keys, [F.col("value_")])
    spans = stored(spans_of(lined), "offsets")
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    counts = spans.select("key_", F.col("n_")).distinct()
    found = _at_ranks(lined, spans, _ends(shares, "n_", F.lit(0)), "value_").join(counts, "key_")
    return lined, spans, stored(_interpolated(found, shares, "n_").withColumnRenamed("n_", "n_distinct"), "quartiles")


def price_summary(observations: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    """Quartiles, outliers and statistics of groups of any size; the same definitions as ``pricing`` has for arrays.

    (keys, n_distinct, p25, p50, p75, n_kept, min_price, max_price, avg_price, median_price): percentiles interpolate over
    distinct prices, fewer than four are all kept, rounding is half to even; prices that are null or not positive don't count.
    """
    lined, spans, q = _quartiles(observations, keys, price)
    iqr, few = F.col("p75") - F.col("p25"), F.col("n_distinct") < 4
    bounds = q.select("key_", F.when(~few, F.col("p25") - 1.5 * iqr).alias("low_"), F.when(~few, F.col("p75") + 1.5 * iqr).alias("high_"))
    kept = _spans_met(lined, spans.join(bounds, "key_")).where("low_ IS NULL OR value_ BETWEEN low_ AND high_")
    rank = F.col("offset_") + F.col("place_") - F.col("first_")
    stats = kept.groupBy("key_").agg(
        F.count("*").alias("n_kept"), F.min(rank).alias("start_"), F.min("value_").alias("min_price"), F.max("value_").alias("max_price"),
        F.bround(F.sum("value_") / F.count("*")).cast("bigint").alias("avg_price"),
    )
    stats = stored(stats, "kept")
    # kept prices are neighbours in the order, so their median is sought from the first of them on
    middle = _at_ranks(lined, spans.join(stats.select("key_", "n_kept", "start_"), "key_"), _ends({"m": 0.5}, "n_kept", F.col("start_")), "value_")
    median = _interpolated(middle.join(stats.select("key_", "n_kept"), "key_"), {"m": 0.5}, "n_kept").select("key_", F.bround("m").cast("bigint").alias("median_price"))
    out = q.join(stats.drop("start_"), "key_").join(median, "key_")
    return out.select(*[F.col(f"key_.{k}").alias(k) for k in keys], "n_distinct", "p25", "p50", "p75", "n_kept", "min_price", "max_price", "avg_price", "median_price")


def price_outliers(observations: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    """(keys, outlier_price): distinct prices further than 1.5 interquartile ranges from the quartiles of their group."""
    lined, spans, q = _quartiles(observations, keys, price)
    iqr = F.col("p75") - F.col("p25")
    bounds = q.where("n_distinct >= 4").select("key_", (F.col("p25") - 1.5 * iqr).alias("low_"), (F.col("p75") + 1.5 * iqr).alias("high_"))
    # prices meet the bounds span by span: by key alone, a key with most of the prices would be one task
    beyond = _spans_met(lined, spans.join(bounds, "key_")).where("value_ < low_ OR value_ > high_")
    return beyond.select(*keys, F.col("value_").alias("outlier_price"))
