"""Near-duplicate documents by min-max hashing, with every link confirmed on full shingle sets.

Each permutation gives two signature values, its minimum and its maximum over a document's shingles, so half as many
hash evaluations fill a signature. Bands of values put documents into buckets. Documents with equal shingle sets are
one class from then on. Links inside buckets are looked for between components only: first with one pivot of each
bucket, then with more, at last between all members that are still in different components. A bucket whose members
are all connected needs no more comparisons. What is left of large buckets is compared in blocks, whose intersections
come from a product of incidence matrices, so no group is ever spread into rows for its pairs, and none is capped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import MOST_PARTITIONS, Words, mix, remove, runs_hash, scratch_path, signed, slices, stored, text_buffers, written

SHINGLE = 5
PERMUTATIONS, ROWS = 64, 4  # 128 values in 32 bands: a pair at 0.75 meets with probability 0.999995
#: Pivots per bucket in successive rounds; 0: all members, of buckets with at most SMALL open members.
PIVOTS = (1, 8, 0)
#: Larger open buckets are compared block by block inside tasks, so that only links come out: rows and shingles of a
#: block, and pairs of blocks that make a partition.
SMALL, BLOCK, BLOCK_SHINGLES, PAIRS = 48, 256, 1 << 18, 16
_rng = np.random.default_rng(5)
_MULTIPLIERS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)


def _shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash), sorted by document; with fewer words, the whole sequence is one shingle."""
    doc = words.doc_of_word()
    start = np.flatnonzero(np.arange(len(doc)) <= words.first[1:][doc] - k)
    doc_of, values = doc[start], runs_hash(words.hashes, k)[start] if len(start) else np.empty(0, np.uint64)
    n_words = np.diff(words.first)
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        own = words.hashes[words.first[d] : words.first[d + 1]]
        doc_of = np.append(doc_of, d)
        values = np.append(values, mix(runs_hash(own, len(own)) + np.uint64(len(own))))
    order = np.lexsort((values, doc_of))
    doc_of, values = doc_of[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc_of[1:] != doc_of[:-1])
    return doc_of[new], values[new]


def _set_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each set's identity: two independent sums over its shingles, which begin at ``at``."""
    if not len(at):
        return np.zeros((2, 0), np.uint64)
    return np.stack([np.add.reduceat(mix(values), at), np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at)])


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for lo, hi in slices(offsets):
                doc, values = _shingles(Words(data, offsets[lo : hi + 1], lower=True), k)
                size = np.bincount(doc, minlength=hi - lo)
                full = np.flatnonzero(size)
                at = np.searchsorted(doc, full)
                signature = np.zeros((len(full), 2 * PERMUTATIONS), np.uint64)
                keys = np.zeros((2, hi - lo), np.uint64)
                if len(full):
                    for j in range(PERMUTATIONS):
                        h = values * _MULTIPLIERS[j] + _ADDENDS[j]
                        h ^= h >> np.uint64(32)
                        signature[:, 2 * j] = np.minimum.reduceat(h, at)
                        signature[:, 2 * j + 1] = np.maximum.reduceat(h, at)
                    keys[:, full] = _set_keys(values, at)
                bands = signature.reshape(len(full), -1, ROWS)
                hashed = np.zeros(bands.shape[:2], np.uint64)
                for r in range(ROWS):
                    hashed = mix(hashed ^ bands[:, :, r])
                hashed = mix(hashed + np.arange(hashed.shape[1], dtype=np.uint64))
                lists_at = np.zeros(hi - lo + 1, np.int32)
                lists_at[1:] = np.cumsum((size > 0) * hashed.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(signed(keys[0])), pa.array(signed(keys[1])), pa.ListArray.from_arrays(pa.array(lists_at), pa.array(signed(hashed.ravel())))],
                    ["doc_id", "n_shingles", "key_1", "key_2", "bands"],
                )

    return run


def _sets(k: int):
    """The set of each row that has one, with its size and identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for lo, hi in slices(offsets):
                doc, values = _shingles(Words(data, offsets[lo : hi + 1], lower=True), k)
                full = np.unique(doc)
                at = np.searchsorted(doc, full)
                keys, ends = _set_keys(values, at), np.append(at, len(values)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo).take(pa.array(full)), pa.array(np.diff(ends).astype(np.int64)), pa.array(signed(keys[0])), pa.array(signed(keys[1])), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(values)))],
                    ["doc_id", "n_shingles", "key_1", "key_2", "shingles"],
                )

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the smallest node reachable. Large-star and small-star in turns."""
    spark = edges.sparkSession
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    path = scratch_path(spark, name)
    stars = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    seen = None
    while True:
        near = both(stars).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both(stars).join(near, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b")))
        last, path = path, scratch_path(spark, name)
        stars = stored(small.distinct(), path)
        remove(spark, last)
        now = stars.agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b")).first()
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def _pivots(members: DataFrame, k: int) -> DataFrame:
    """Up to ``k`` members of each bucket, combined before the shuffle; all of them for 0.

    A member whose buckets are fullest is the most central, as the source of a group of copies is, and links with most
    others; so the heaviest of each of ``k`` hash classes is taken, the smallest document among equals.
    """
    if k == 0:
        return members
    central = F.max_by(F.struct("doc", "component", "size"), F.struct("weight", (-F.col("doc")).alias("d"))).alias("p")
    return members.groupBy("bucket", F.pmod(F.xxhash64("doc"), F.lit(k)).alias("turn")).agg(central).select("bucket", "p.*")


def _forest(linked: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Of the linked pairs of rows, as many as it takes to connect the components that they connect."""
    _, code = np.unique(component, return_inverse=True)
    n = int(code.max()) + 1
    i, j = np.nonzero(linked)
    pair = np.full((n, n), -1, np.int64)
    pair[code[i], code[j]] = i * len(linked) + j
    left, chosen = np.ones(n, bool), []
    for first in range(n):
        reached = [first] if left[first] else []
        left[first] = False
        while reached:
            u = reached.pop()
            new = np.flatnonzero((pair[u] >= 0) & left)
            left[new] = False
            chosen += pair[u, new].tolist()
            reached += new.tolist()
    return np.stack(np.divmod(np.array(chosen, np.int64), len(linked)), 1)


def _block_links(percent: int):
    """Links that connect different components inside each (bucket, lo, hi), whose rows come together."""

    def links_of(part: pa.Table) -> pa.RecordBatch:
        doc, component = part.column("doc").to_numpy(), part.column("component").to_numpy()
        sets = part.column("shingles").combine_chunks()
        lengths = np.diff(np.asarray(sets.offsets))
        _, back, count = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(doc)), lengths)
        shared = count > 1
        column = np.cumsum(shared) - 1
        use = shared[back]
        row, col = row[use], column[back[use]]
        both = np.zeros((len(doc), len(doc)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for lo in range(0, int(shared.sum()), 2048):
            a, b = np.searchsorted(col, (lo, lo + 2048))
            m = np.zeros((len(doc), 2048), np.float32)
            m[row[a:b], col[a:b] - lo] = 1
            both += m @ m.T
        both = both.astype(np.int64)  # exact there up to 2**24 shared shingles, and with the factor of 100 here
        union = lengths[:, None] + lengths[None, :] - both
        chosen = doc[_forest((both * 100 >= union * percent) & (component[:, None] != component[None, :]), component)]
        return pa.RecordBatch.from_arrays([pa.array(chosen.min(1, initial=np.iinfo(np.int64).max)), pa.array(chosen.max(1, initial=-1))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in itertools.chain(batches, [None]):
            n = 0 if batch is None else batch.num_rows
            key = np.stack([batch.column(c).to_numpy() for c in ("bucket", "lo", "hi")], 1) if n else np.empty((0, 3), np.int64)
            edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), n]
            for a, b in zip(edge[:-1], edge[1:]) if n else [(0, 0)] if batch is None else []:
                here = key[a].tolist() if n else None
                if here != current:
                    if sum(h.num_rows for h in held) > 1:
                        yield links_of(pa.Table.from_batches(held))
                    current, held = here, []
                if n:
                    held.append(batch.slice(a, b - a))

    return run


def _links_of_large(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links in large open buckets. ``members``: bucket, doc, component, n and shingles (of the bucket's open members)."""
    members = members.withColumn("chunks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int"))
    pairs = members.groupBy("bucket").agg(F.first("chunks").alias("c")).agg(F.sum(F.col("c") * (F.col("c") + 1) / 2)).first()[0] or 0
    partitions = max(3 * members.sparkSession.sparkContext.defaultParallelism, min(MOST_PARTITIONS, math.ceil(pairs / PAIRS)))
    own = members.select("bucket", "doc", "component", "chunks", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int").alias("own"))
    dealt = own.select("bucket", "doc", "component", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "doc", "component")
    rows = dealt.join(sets, dealt.doc == sets.doc_id).select("bucket", "lo", "hi", "doc", "component", "shingles")
    return rows.repartition(partitions, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(_block_links(percent), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Two documents are linked if their sets of distinct ``shingle``-word shingles (A-Z lower-cased) have 100 x
    intersection >= ``percent`` x union. A null, empty or wordless text has an empty set and is linked with nothing.
    Rows that share an id are one node, with the least set of theirs (by size, then by the sets' hashes) that is not
    empty, and each of them gets a row. A row with a null id is linked with nothing and has a null component_id and
    kept true. An empty table gives no rows; other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed_docs = written(base.mapInArrow(_signatures(shingle), "doc_id bigint, n_shingles bigint, key_1 bigint, key_2 bigint, bands array<bigint>"), "signatures")
    sets_of_docs = signed_docs.where("doc_id is not null and n_shingles > 0")
    nodes = written(sets_of_docs.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "key_1", "key_2", "bands")).alias("r")).select("doc_id", "r.*"), "nodes")
    # Equal sets are one class, represented by its smallest document.
    classes = nodes.groupBy("key_1", "key_2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r")).select("key_1", "key_2", "r.*")
    rows = classes.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(rows.join(shared, "bucket"), "buckets")
    involved = written(buckets.groupBy("doc").agg(F.sum("n").alias("weight")), "involved")
    wanted = base.join(involved, base.doc_id == involved.doc).select("doc_id", "text").mapInArrow(_sets(shingle), "doc_id bigint, n_shingles bigint, key_1 bigint, key_2 bigint, shingles array<bigint>")
    sets = written(wanted.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "key_1", "key_2", "shingles")).alias("r")).select("doc_id", "r.shingles"), "shingle-sets")
    links, tried, labels = None, None, involved.select(F.col("doc").alias("node"), F.col("doc").alias("component"), "weight")
    for k in PIVOTS:
        members = buckets.join(labels, buckets.doc == labels.node).select("bucket", "doc", "size", "component", "weight")
        open_buckets = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("shingles")).where("lo < hi").select("bucket", "n", "shingles")
        members = members.join(open_buckets, "bucket")
        crowded = None
        if k == 0:
            members = written(members, "open-members")
            crowded, members = members.where(F.col("n") > SMALL), members.where(F.col("n") <= SMALL)
        pivots = _pivots(members, k).select("bucket", F.col("doc").alias("pivot"), F.col("component").alias("pivot_component"), F.col("size").alias("pivot_size"))
        small, large = F.least("size", "pivot_size"), F.greatest("size", "pivot_size")
        pairs = (
            members.join(pivots, "bucket")
            .where((F.col("component") != F.col("pivot_component")) & (small * 100 >= large * percent))
            .select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b"))
            .distinct()
        )
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if pairs.isEmpty() and (crowded is None or crowded.isEmpty()):
            continue
        tried = pairs if tried is None else tried.unionAll(pairs)
        left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
        both = F.size(F.array_intersect("set_a", "set_b"))
        found = pairs.join(left, "a").join(right, "b").where(both * 100 >= (F.size("set_a") + F.size("set_b") - both) * percent).select("a", "b")
        if crowded is not None:
            found = found.unionAll(_links_of_large(crowded, sets, percent))
        links = written(found if links is None else found.unionAll(links), "links")
        joined = components(links)
        labels = involved.join(joined, involved.doc == joined.node, "left").select(F.col("doc").alias("node"), F.coalesce("component", "doc").alias("component"), "weight")
    reps = classes.select("key_1", "key_2", F.col("doc_id").alias("rep"))
    by_class = reps.join(labels, reps.rep == labels.node, "left").select("key_1", "key_2", F.coalesce("component", "rep").alias("component"))
    by_node = nodes.select("doc_id", "key_1", "key_2").join(by_class, ["key_1", "key_2"]).select("doc_id", "component")
    linked = signed_docs.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles").join(by_node, "doc_id")
    alone = signed_docs.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = linked.unionByName(alone).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
