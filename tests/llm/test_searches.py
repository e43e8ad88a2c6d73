"""The vector searches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from marketloom.llm import exact_topk, ivf, queries

VECTORS = "vec_id bigint, embedding array<float>, label int, score double, list int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 0.0, 1) for i, v in vectors], VECTORS)


def sample(n=600, dim=16, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype("float32")
    x[100:300] = x[100]  # one vector that a third of all rows share
    return x


def test_ivf_recall_scores_and_edges(spark):
    x = sample()
    odd = [(None, [1.0] * 16), (1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [])]
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] + odd)
    got: dict = {}
    for r in ivf.search(df, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    y = x.astype(float)
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        assert all(abs(d[v] - s) < 1e-12 and v != q for _, v, s in rows)
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(600), d))[:10]) & {v for _, v, _ in rows})
    assert hits / (10 * len(got)) >= 0.9
    assert [v for _, v, _ in sorted(got[100])] == list(range(101, 111))  # ties to smaller ids


def recall(x, ids, found, step):
    got: dict = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in ids[ids % step == 0]:
        d = ((x - x[ids == q]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    return hits / (10 * len(got))


def test_ivf_registered_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    found = queries.op8_ivf_search(spark, "/root/testdata/sf0.1").collect()
    assert recall(x, ids, found, 100) >= 0.9
    # Clustered vectors need few lists: the share follows the data.
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 5
    y = centres[rng.integers(0, 40, 5000)] + rng.normal(size=(5000, 16)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id bigint, embedding array<double>")
    assert recall(y, np.arange(5000), ivf.search(df, F.col("vec_id") % 100 == 0).collect(), 100) >= 0.9
    index = ivf.fit(df, 5000, 10, None)
    assert index.n_probed < 0.3 * len(index.centres)


def test_adaptive_scan_drops_pairs():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 64)) * 4
    rows = centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 64)) * 0.3
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    queries = rows[:50]
    qi, ri, work = ivf.scan_block(queries @ rotation, rows @ rotation, 10, np.arange(50))
    assert work < 0.5 * 50 * 2000 * 4  # of four steps of dimensions for all pairs
    assert not (qi == ri).any()
    known = np.partition(((queries[:, None] - rows[None, :]) ** 2).sum(2), 10, 1)[:, 10]
    assert ivf.scan_block(queries @ rotation, rows @ rotation, 10, np.arange(50), known)[2] < work


def test_ivf_few_and_none(spark):
    df = frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (100, [3.0, 2.0]), (200, [1.0]), (300, [1.0, 2.0, 3.0])])
    rows = ivf.search(df, F.col("vec_id") % 100 == 0, k=10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in rows) == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]
    assert ivf.search(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert ivf.search(df.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_ivf_is_complete_at_every_small_size(spark):
    x = np.random.default_rng(6).normal(size=(50, 4))
    for n in (1, 2, 5, 9, 10, 11, 12, 23, 50):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:n])], "vec_id bigint, embedding array<double>")
        counts = {r.query_id: r["count"] for r in ivf.search(df, F.col("vec_id") >= 0, k=10).groupBy("query_id").count().collect()}
        assert counts == ({q: min(10, n - 1) for q in range(n)} if n > 1 else {})


def test_ivf_repeated_ids(spark):
    df = frame(spark, [(0, [1.0, 2.0]), (0, [9.0, 9.0]), (1, [1.0, 2.5]), (1, [1.0, 2.5]), (2, [1.0, 4.0])])
    rows = ivf.search(df, F.col("vec_id") == 1, k=10).collect()  # two equal queries share a ranking: each pair counts twice
    far = float(np.hypot(8, 6.5))
    assert sorted((r.rank, r.vec_id, r.score) for r in rows) == [(1, 0, 0.5), (2, 0, 0.5), (3, 2, 1.5), (4, 2, 1.5), (5, 0, far), (6, 0, far)]
    rows = ivf.search(df, F.col("vec_id") == 2, k=3).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in rows) == [(1, 1, 1.5), (2, 1, 1.5), (3, 0, 2.0)]


def test_ivf_hot_id(spark):
    """A third of all rows share an id: none is lost, and equal rows are as many as they were."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 3)), 3)
    rows = [(7 if i < 100 else i, v.tolist()) for i, v in enumerate(x)] + [(7, x[0].tolist())] * 40
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ivf.search(table, F.col("vec_id") == 150, k=120, probed=1.0).collect()
    apart = sorted((float(np.sqrt(((x[150] - np.array(v)) ** 2).sum())), i) for i, v in rows if i != 150)[:120]
    assert [(r.vec_id, round(r.score, 9)) for r in sorted(got, key=lambda r: r.rank)] == [(i, round(d, 9)) for d, i in apart]


def test_exact_topk_repeated_ids_as_its_sql(spark, tmp_path):
    """The registered SQL and the query over a table with repeated ids and rows."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from marketloom.llm import queries

    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in rng.integers(0, 120, 400)]
    rows += [rows[0]] * 9 + [(50, rows[3][1])] * 3 + [(None, rows[4][1]), (1, None)]
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    pq.write_table(table, f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLES["op9_exact_topk"]).fetchall())
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in queries.op9_exact_topk(spark, str(tmp_path)).collect())
    assert got == want and len(got) == 5 * len({r[0] for r in rows if r[0] is not None and r[0] % 50 == 0})


def test_ivf_probes_until_there_are_k(spark):
    x = sample(101, 4)[:9]
    got: dict = {}
    for r in ivf.search(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") >= 0, k=10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got == {q: set(range(9)) - {q} for q in range(9)}
    few = np.concatenate([np.zeros((995, 2)) + 1, [[50, 0], [51, 0], [52, 0], [53, 0], [54, 0]]])
    rows = ivf.search(frame(spark, [(i, v.tolist()) for i, v in enumerate(few)]), F.col("vec_id") >= 995, k=10).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in rows} == dict.fromkeys(range(995, 1000), 10)


def brute(weights, query_ids, k):
    out = []
    for q in query_ids:
        best = sorted(((-sum(a * b for a, b in zip(weights[q], w)), i) for i, w in weights.items() if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_exact_topk(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(exact_topk, "QUERY_ROWS", 10)
    monkeypatch.setattr(exact_topk, "FIRST_ROWS", 50)
    x = np.floor(256 * sample().astype(float)).astype(int)
    weights = {i: v.tolist() for i, v in enumerate(x)}
    rows = [*weights.items(), (None, [1] * 16), (2000, None), (2001, [1] * 15), (2002, [None] * 16), (2003, [])]
    df = spark.createDataFrame([(i, w, 1) for i, w in rows], "vec_id bigint, weights array<bigint>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.search(df, F.col("vec_id") % 50 == 0, k=5).collect())
    assert got == brute(weights, range(0, 600, 50), 5)
    assert exact_topk.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert len(exact_topk.search(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()) == 2


def test_exact_topk_of_large_weights(spark):
    """Scores beyond a double's whole numbers."""
    x = np.random.default_rng(2).integers(-(2**24) + 1, 2**24, (60, 64))
    weights = {i: v.tolist() for i, v in enumerate(x)}
    df = spark.createDataFrame(list(weights.items()), "vec_id bigint, weights array<bigint>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.search(df, F.col("vec_id") % 50 == 0, k=5).collect())
    assert got == brute(weights, (0, 50), 5)


def test_maxscore_splits_by_bounds():
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(4000, 64)) * 10).astype(np.int64)
    query = (rng.normal(size=64) * np.linspace(30, 0.1, 64)).astype(np.int64)
    scores = np.sort(rows @ query)
    high, low = rows.max(0), rows.min(0)
    reads, sizes = [], []
    for need in (exact_topk.NONE, float(scores[2000]), float(scores[-100]), float(scores[-5])):
        found, score, read = exact_topk.maxscore(query, rows.T, high, low, 5, -1, need)
        assert set(np.argsort(-(rows @ query), kind="stable")[:5]) <= set(found.tolist())
        assert (score == rows[found] @ query).all()
        most, least = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
        order = np.argsort(least - most, kind="stable")
        sizes.append(exact_topk.essential_terms(least[order], most[order], need))
        reads.append(read)
    assert sizes == sorted(sizes, reverse=True) and 64 == sizes[0] > sizes[1] > sizes[3] > 0  # fewer essential terms as the threshold rises
    assert reads[0] == rows.size > reads[1] > reads[3] and reads[3] < 0.6 * rows.size
    assert exact_topk.maxscore(query, rows.T, high, low, 5, -1, float("inf"))[2] == 0  # a shard that can't compete is not read
