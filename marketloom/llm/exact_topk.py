"""Exact top-k by inner product with MaxScore, over shards of rows.

A vector's components are the weights of its terms, and a term's postings are its column in a shard. A first pass
scores each query against a bounded sample of rows; the k-th best score there is a threshold that all shards start
from. In a shard, a query's terms are ordered by how much they can move a score (from the shard's extremes for each
term). The longest tail of terms that cannot lift any row to the threshold, were the other terms at their least, is
non-essential. Essential postings are traversed; the others are probed, some at a time, only for rows whose bound can
still reach the threshold, which rises as scores come in. So results are exact. Results of all shards are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import least_hashes, meetings, met, same_length, vector_rows, written

#: Rows of a shard, queries met with it at once, rows of the first pass, and terms probed at a time.
SHARD_ROWS, QUERY_ROWS, FIRST_ROWS, PROBED = 8192, 512, 2048, 8
#: A threshold that every score reaches.
NONE = float("-inf")


def essential_terms(low: np.ndarray, high: np.ndarray, need: float) -> int:
    """How many terms, in this order, are essential: with these at ``low``, the others at ``high`` stay under ``need``."""
    least, most = np.concatenate([[0], np.cumsum(low)]), np.concatenate([np.cumsum(high[::-1])[::-1], [0]])
    under = np.flatnonzero(least + most < need)
    return int(under[0]) if len(under) else len(low)


def maxscore(query: np.ndarray, postings: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, skip: int | np.ndarray, need: float = NONE) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows that can be among the query's k best, with their scores; and the postings read.

    ``postings``: terms x rows. ``high`` and ``low``: each term's extremes. ``skip``: the row that is the query, or -1; or all rows that are.
    """
    n = postings.shape[1]
    most, least = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
    order = np.argsort(least - most, kind="stable")  # widest first
    weights, most, least = query[order], most[order], least[order]
    bound, floor = (np.concatenate([np.cumsum(x[::-1])[::-1], [0]]) for x in (most, least))  # of the terms from each place on
    at = essential_terms(least, most, need)
    alive = np.delete(np.arange(n), skip) if np.ndim(skip) or skip >= 0 else np.arange(n)
    part, read = (weights[:at] @ postings[order[:at]])[alive], n * at
    while True:
        stay = part + bound[at] >= need
        alive, part = alive[stay], part[stay]
        if at == len(query):
            return alive, part, read
        if len(part) >= k:  # the k-th best of what these rows score at least
            need = max(need, float(np.partition(part, len(part) - k)[len(part) - k] + floor[at]))
        stop = min(len(query), at + PROBED)
        part = part + weights[at:stop] @ postings[np.ix_(order[at:stop], alive)]
        read += len(alive) * (stop - at)
        at = stop


def exact_numbers(weights: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles, if all products and sums over their terms stay exact there; else as they are."""
    top = float(np.abs(weights).max(initial=0))
    return weights.astype(np.float64) if top * top * weights.shape[-1] < 2**53 else weights


def _started(first: np.ndarray, ids: np.ndarray, k: int):
    """Queries with the k-th best score among the first pass's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(lo, QUERY_ROWS)
                both = exact_numbers(np.concatenate([vector_rows(batch.column("weights")), first]))
                scores = (both[: batch.num_rows] @ both[batch.num_rows :].T).astype(np.float64)
                scores[batch.column("vec_id").to_numpy()[:, None] == ids[None, :]] = NONE
                need = np.partition(scores, -k, 1)[:, -k] if len(ids) > k else np.full(len(scores), NONE)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.nextafter(need, NONE))], [*batch.schema.names, "need"])

    return run


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for block, queries in meetings(batches, ["shard"], QUERY_ROWS):
            if block is not held:
                held, ids, copies = block, block.column("vec_id").to_numpy(), block.column("copies").to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, copies, rows = ids[order], copies[order], exact_numbers(vector_rows(block.column("weights"))[order])
                high, low, postings = rows.max(0), rows.min(0), np.ascontiguousarray(rows.T)
            out: list[tuple] = []
            asked = vector_rows(queries.column("weights"))
            same = exact_numbers(np.concatenate([asked, [high.astype(np.int64), low.astype(np.int64)]])).dtype
            for query_id, weights, need, own in zip(queries.column("vec_id").to_numpy(), asked.astype(same), queries.column("need").to_numpy(), queries.column("copies").to_numpy()):
                skip = np.arange(np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, "right"))
                found, score, _ = maxscore(weights, postings.astype(same, copy=False), high.astype(same), low.astype(same), k, skip, need)
                best = np.lexsort((ids[found], -score))[:k]
                times = np.minimum(k, np.minimum(k, copies[found[best]]) * min(k, own))
                out.append((np.full(len(best), query_id), ids[found[best]], score[best].astype(np.int64), times))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score", "times"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, ties to smaller ids.

    ``vectors``: vec_id, weights (array of long). Rows with a null id, or whose weights are null, empty or hold a null,
    take no part; nor do vectors of another length than the most frequent one (the greatest of several). Every row
    counts, also one whose id or whole is repeated: a query's candidates are all rows with another id, and queries of
    one id share one ranking. Equal rows travel as one, with their number. With fewer than ``k`` candidates all are
    returned; an empty table gives no rows; other columns are not read. Weights of magnitude below 2**24 can't overflow.
    """
    whole = (F.size("weights") > 0) & ~F.exists("weights", lambda x: x.isNull())
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "weights").where(F.col("vec_id").isNotNull() & whole)
    good, n = same_length(written(good.groupBy("vec_id", "weights").agg(F.count("*").alias("copies")), "weights"), "weights")
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    first = least_hashes(good, "vec_id", n, FIRST_ROWS).orderBy(F.xxhash64("vec_id"), "vec_id", "weights").limit(FIRST_ROWS).toArrow()
    shards = math.ceil(n / SHARD_ROWS)
    rows = good.withColumn("shard", F.pmod(F.xxhash64("vec_id", "weights"), F.lit(shards)).cast("int"))
    started = good.where(is_query).mapInArrow(_started(vector_rows(first.column("weights")), first.column("vec_id").to_numpy(), k), "vec_id bigint, weights array<bigint>, copies bigint, need double")
    asked = started.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = met(rows, asked, ["shard"], shards).mapInArrow(_searched(k), "query_id bigint, vec_id bigint, score bigint, times bigint")
    found = found.select("query_id", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
