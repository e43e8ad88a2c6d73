"""The relational steps of a pricing run, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key, as a dictionary that is overwritten would hold; combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, "v.*")


def first_seen(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, "v.*")


def lookup(rows: DataFrame, dimension: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``rows`` with the last value of each key, NULL where the key is unknown. Spark broadcasts the side it finds small."""
    return rows.join(last_write(dimension, keys, order, values), keys, "left")


def top_k(rows: DataFrame, partition: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each partition with their rank; Spark limits each task's rows before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(rank) <= k)


def progressive_stop(rows: DataFrame, partition: list[str], order: list[Column], hit: Column, batch: int, enough: int) -> DataFrame:
    """Rows that are still looked at when work goes in batches and stops before the first batch with ``enough`` hits behind it.

    For groups of bounded size, such as the fifty candidates of a row; ``ranks.progressive_stop`` takes groups of any size.
    """
    numbered = rows.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) / batch).cast("int"))
    before = Window.partitionBy(*partition).orderBy("batch_no").rangeBetween(Window.unboundedPreceding, -1)
    return numbered.withColumn("hits_before", F.coalesce(F.sum(hit.cast("int")).over(before), F.lit(0))).where(F.col("hits_before") < enough)


def ttl_lookup(requests: DataFrame, cache: DataFrame, keys: list[str], ttl_us: int) -> DataFrame:
    """Each request (keys, at, perhaps more) with the newest entry of its key written up to then and not older than the TTL.

    One pass over requests and entries of a key in order of time, never a join of all with all. Time is cut into slots
    of the TTL's length, an entry standing in its own slot and the next, so a busy key is many small windows. Of entries
    written at one time the greatest value counts; a request with a null key finds nothing.
    """
    slot = lambda t: F.floor(F.col(t) / ttl_us)
    known = F.col("written_at").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    entries = cache.where(known).select(*keys, F.explode(F.array(slot("written_at"), slot("written_at") + 1)).alias("slot"), F.col("written_at").alias("t"), F.lit(False).alias("asks"), F.struct("written_at", "value").alias("entry"))
    asked = requests.select(*keys, slot("at").alias("slot"), F.col("at").alias("t"), F.lit(True).alias("asks"), F.struct(*requests.columns).alias("request"))
    by_time = Window.partitionBy(*keys, "slot").orderBy("t", "asks", "entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = entries.unionByName(asked, allowMissingColumns=True).withColumn("newest", F.last("entry", ignorenulls=True).over(by_time)).where("asks")
    value = F.when(F.col("t") - F.col("newest.written_at") <= ttl_us, F.col("newest.value"))
    return both.select("request.*", value.alias("value"))


def best_offer(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One offer of each key: not struck through if there is one, then the lowest positive price, then the first."""
    rank = F.struct("is_original", F.when(F.col("is_original"), F.lit(0)).otherwise(F.when(F.col("price") > 0, F.col("price")).otherwise(F.lit(2**62))), "position")
    return rows.groupBy(*keys).agg(F.min_by(F.struct("price", "is_original", "position"), rank).alias("v")).select(*keys, "v.*")


def find_header(headers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(field, idx): for each field, the header that the first matching candidate name finds first.

    ``headers``: idx, header (normalised); ``candidates``: field, position, candidate (normalised). A sheet has a few
    dozen of either, so both are small by nature. A name matches in full, as a beginning, or inside once all but
    letters and digits is gone, unless only one of the two is a percentage.
    """
    bare = lambda c: F.regexp_replace(c, "[^a-z0-9]", "")
    same_unit = F.col("candidate").contains("%") == F.col("header").contains("%")
    inside = same_unit & (bare("candidate") != "") & F.contains(bare("header"), bare("candidate"))
    hit = F.col("header").startswith(F.col("candidate")) | inside
    met = candidates.join(F.broadcast(headers), hit, "left").where("idx is not null")
    found = met.groupBy("field").agg(F.min_by("idx", F.struct("position", "idx")).alias("idx"))
    return candidates.select("field").distinct().join(found, "field", "left").select("field", F.coalesce("idx", F.lit(-1)).alias("idx"))
