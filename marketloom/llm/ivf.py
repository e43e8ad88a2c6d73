"""Approximate nearest neighbours: inverted lists scanned with adaptive dimensions.

Vectors are assigned to the nearest of a set of centroids and rotated by a random orthogonal matrix. A query probes
its nearest lists. There its distance to the list's vectors grows by blocks of rotated dimensions; after each block a
hypothesis test drops the vectors whose partial distance already tells that they can't be among the nearest. Lists
are dealt out in blocks of bounded size, so a list that holds a third of all vectors is many blocks. A vector is moved
once, to its block; queries are copied to the blocks that they probe, and stream past them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import least_hashes, meetings, met, same_length, vector_rows, written

#: Vectors that the centroids and the number of probes are fitted on, at most (by hash of id), and lists; every vector is indexed.
SAMPLE_ROWS, MAX_LISTS = 20_000, 1024
#: Vectors of the sample whose neighbours in it tell how many lists to probe; as many of its rows give queries a first bound.
TUNING_ROWS, BOUND_ROWS = 512, 2048
#: Rows of a list's block, queries met with it at once, rows scanned before bounds are renewed, dimensions added at a time, and the test's strictness.
BLOCK_ROWS, QUERY_ROWS, CHUNK_ROWS, STEP, EPSILON = 4096, 256, 256, 16, 2.6
#: The share of the sample's nearest neighbours that the probed lists must hold.
TARGET = 0.97


def usable(vector: str = "embedding") -> Column:
    """Not null, not empty, finite throughout, and not zero."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :]


class Index:
    """Centroids, a rotation, the number of lists to probe, and some rows for first bounds; bounded in size."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, n_rows: int, k: int, probed: float | None, seed: int = 11):
        rng = np.random.default_rng(seed)
        dim = x.shape[1] if len(x) else 1
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        distinct = np.unique(x, axis=0)
        n_lists = max(1, min(MAX_LISTS, int(math.sqrt(n_rows)), len(distinct)))
        centres = distinct[rng.permutation(len(distinct))[:n_lists]]
        for _ in range(8):
            nearest = np.argmin(_squared(distinct, centres), 1)
            sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
            np.add.at(sums, nearest, distinct)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        self.centres = centres
        self.ids, self.rows = ids[:BOUND_ROWS], x[:BOUND_ROWS]
        self.lists = self.nearest(self.rows)
        self.n_probed = max(1, min(n_lists, math.ceil(probed * n_lists))) if probed is not None else self._tuned(x, k)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(_squared(x, self.centres), 1)

    def _tuned(self, x: np.ndarray, k: int) -> int:
        """How many of its nearest lists a vector must probe to find TARGET of its nearest neighbours in the sample."""
        own, asked = self.nearest(x), x[:TUNING_ROWS]
        apart = _squared(asked, x)
        apart[np.arange(len(asked)), np.arange(len(asked))] = np.inf
        kept = min(k, max(1, len(x) - 1))
        near = np.argpartition(apart, kept - 1, 1)[:, :kept]
        order = np.argsort(_squared(asked, self.centres), 1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        needed = np.sort(np.take_along_axis(place, own[near], 1).ravel()) + 1
        return int(needed[min(len(needed) - 1, math.ceil(TARGET * len(needed)) - 1)])

    def probes(self, x: np.ndarray, sizes: np.ndarray, least: int | np.ndarray) -> list[np.ndarray]:
        """Each row's nearest lists: ``n_probed`` of them, or as many more as it takes to hold ``least`` rows by ``sizes``."""
        order = np.argsort(_squared(x, self.centres), 1, kind="stable")
        short = (np.cumsum(sizes[order], 1) < least).sum(1)  # lists that do not reach it yet
        n_lists = np.minimum(np.maximum(self.n_probed, short + 1), order.shape[1])
        return [o[:n] for o, n in zip(order, n_lists)]

    def bounds(self, ids: np.ndarray, x: np.ndarray, probes: list[np.ndarray], k: int) -> np.ndarray:
        """An upper bound of each row's k-th smallest squared distance, from the sample's rows in its lists."""
        apart = _squared(x, self.rows)
        apart[ids[:, None] == self.ids[None, :]] = np.inf
        probed = np.zeros((len(x), len(self.centres)), bool)
        for row, lists in zip(probed, probes):
            row[lists] = True
        apart[~probed[:, self.lists]] = np.inf
        return np.partition(apart, k - 1, 1)[:, k - 1] * (1 + 1e-9) + 1e-9 if apart.shape[1] >= k else np.full(len(x), np.inf)


def fit(vectors: DataFrame, n_rows: int, k: int, probed: float | None) -> Index:
    sample = least_hashes(vectors, "vec_id", n_rows, SAMPLE_ROWS).orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE_ROWS).toArrow()
    return Index(vector_rows(sample.column("embedding")), sample.column("vec_id").to_numpy(), n_rows, k, probed)


def _listed(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = index.nearest(vector_rows(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists.astype(np.int32))], [*batch.schema.names, "list"])

    return run


def _probing(index: Index, sizes: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(lo, QUERY_ROWS)
                x, ids = vector_rows(batch.column("embedding")), batch.column("vec_id").to_numpy()
                probes = index.probes(x, sizes, k + batch.column("own").to_numpy()[:, None])
                at = np.concatenate([[0], np.cumsum([len(p) for p in probes])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(probes).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("vec_id", "embedding", "copies")), lists, pa.array(index.bounds(ids, x, probes, k))], ["vec_id", "embedding", "copies", "lists", "bound"])

    return run


def scan_block(q: np.ndarray, r: np.ndarray, k: int, own: np.ndarray, bounds: np.ndarray | None = None, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, row) that may be among the k nearest of this block, and how many dimension steps were taken.

    Queries and rows are rotated. Rows come in chunks; each query's bound is the lesser of ``bounds`` and its k-th
    smallest squared distance so far. Over the blocks of dimensions a row goes when its partial squared distance over d
    of D dimensions exceeds bound * (d / D) * (1 + EPSILON / sqrt(d))**2. ``own``: the row that is the query itself, or
    -1; or the first and the end of rows with the query's id, in two columns.
    """
    own_lo, own_hi = (own[:, :1], own[:, 1:]) if own.ndim == 2 else (own[:, None], own[:, None] + 1)
    dim, work, kept = q.shape[1], 0, []
    first_bound = np.full(len(q), np.inf) if bounds is None else bounds
    best = np.full((len(q), k), np.inf)
    for first in range(0, len(r), CHUNK_ROWS):
        chunk = r[first : first + CHUNK_ROWS]
        bound = np.minimum(best.max(1), first_bound)
        part = _squared(q[:, :step], chunk[:, :step])  # the first block of dimensions, for all pairs at once
        work += part.size
        limit = lambda hi: bound * (hi / dim) * ((1 + EPSILON / math.sqrt(hi)) ** 2 if hi < dim else 1) * (1 + 1e-6) + 1e-9  # noqa: E731, B023
        places = np.arange(first, first + len(chunk))[None, :]
        stay = (part <= limit(min(step, dim))[:, None]) & ((places < own_lo) | (places >= own_hi))
        qi, ri = np.nonzero(stay)
        part = part[qi, ri]
        for lo in range(step, dim, step):
            hi = min(dim, lo + step)
            part = part + ((q[qi, lo:hi] - chunk[ri, lo:hi]) ** 2).sum(1)
            work += len(qi)
            keep = part <= limit(hi)[qi]  # at the last dimension the distance is whole and the factor is 1, but for rounding
            qi, ri, part = qi[keep], ri[keep], part[keep]
        near = np.full((len(q), k + len(chunk)), np.inf)
        near[:, :k] = best
        near[qi, k + ri] = part
        best = np.partition(near, k - 1, 1)[:, :k]
        kept.append((qi, ri + first))
    return np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept]), work


def _searched(rotation: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for block, queries in meetings(batches, ["list", "block"], QUERY_ROWS):
            if block is not held:
                held, r, r_id, copies = block, vector_rows(block.column("embedding")), block.column("vec_id").to_numpy(), block.column("copies").to_numpy()
                order = np.argsort(r_id, kind="stable")
                r, r_id, copies = r[order], r_id[order], copies[order]
                turned = r @ rotation
            q, q_id = vector_rows(queries.column("embedding")), queries.column("vec_id").to_numpy()
            own = np.stack([np.searchsorted(r_id, q_id), np.searchsorted(r_id, q_id, "right")], 1)
            qi, ri, _ = scan_block(q @ rotation, turned, k, own, queries.column("bound").to_numpy())
            exact = np.sqrt(((q[qi] - r[ri]) ** 2).sum(1))
            order = np.lexsort((r_id[ri], exact, qi))
            qi, ri, exact = qi[order], ri[order], exact[order]
            keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
            times = np.minimum(k, np.minimum(k, copies[ri]) * np.minimum(k, queries.column("copies").to_numpy()[qi]))
            yield pa.RecordBatch.from_arrays([pa.array(q_id[qi[keep]]), pa.array(r_id[ri[keep]]), pa.array(exact[keep]), pa.array(times[keep])], ["query_id", "vec_id", "score", "times"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, probed: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, by Euclidean distance, ties to smaller ids.

    ``vectors``: vec_id, embedding (floats or doubles). ``probed``: the share of lists to probe; by default it is chosen
    so that the lists hold TARGET of a bounded sample's nearest neighbours. Rows whose id is null, or whose vector is
    null, empty, zero or not finite, take no part, as queries or candidates; nor do vectors of another length than the
    most frequent one (the greatest of several). Every row counts, also one whose id or whole is repeated: a query's
    candidates are all rows with another id, and queries of one id share one ranking. Equal rows travel as one, with
    their number. With fewer than ``k`` candidates all are returned: beyond its share of lists, a query probes as many
    more as hold ``k`` others. An empty table gives no rows; other columns are not read.
    """
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable() & F.col("vec_id").isNotNull())
    good, n = same_length(written(good.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")), "vectors"), "embedding")
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = fit(good, n, k, probed)
    kind = f"vec_id bigint, embedding {good.schema['embedding'].dataType.simpleString()}, copies bigint"
    rows = written(good.mapInArrow(_listed(index), f"{kind}, list int"), "lists")
    held = np.zeros(len(index.centres), np.int64)
    for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row for each list: at most MAX_LISTS
        held[r.list] = r.n
    blocks = -(-held // BLOCK_ROWS)
    n_blocks = F.get(F.array(*[F.lit(int(b)) for b in blocks]), F.col("list"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), n_blocks).cast("int"))
    asked = rows.where(is_query).drop("list", "block")
    several = asked.groupBy("vec_id").agg(F.count("*").alias("several")).where("several > 1")  # ids with more than one vector
    asked = asked.join(several, "vec_id", "left").select("vec_id", "embedding", "copies", F.coalesce("several", F.lit(1)).alias("own"))
    probes = asked.mapInArrow(_probing(index, held, k), f"{kind}, lists array<int>, bound double")
    probes = probes.select("vec_id", "embedding", "copies", "bound", F.explode("lists").alias("list")).where(n_blocks > 0)
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    found = met(rows, probes, ["list", "block"], math.ceil(n / BLOCK_ROWS)).mapInArrow(_searched(index.rotation, k), "query_id bigint, vec_id bigint, score double, times bigint")
    found = found.select("query_id", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
