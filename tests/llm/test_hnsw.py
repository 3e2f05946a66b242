import numpy as np

from rimward.llm import hnsw

VECS = "vec_id long, embedding array<float>, label int, dim string"


def brute(rows, k, step):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_recall_ties_and_left_out_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), 0, "x") for i in range(1500)]
    rows += [(2000 + i, rows[40][1], 0, "x") for i in range(300)]
    bad = [(3000, None, 0, "x"), (3020, [0.0] * 16, 0, "x"), (3040, [float("nan")] + [1.0] * 15, 0, "x"), (3060, [None] + [1.0] * 15, 0, "x"), (3080, [], 0, "x"), (None, [9.0] * 16, 0, "x"), (3100, [float("inf")] + [1.0] * 15, 0, "x"), rows[20]]
    df = spark.createDataFrame(rows + bad, VECS).repartition(3)
    got = {}
    for r in hnsw.nearest(df, k=10, query_step=20, shard_rows=500, query_block=30).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows, 10, 20)
    assert got.keys() == want.keys()
    assert all(len(v) == 10 and len(set(v)) == 10 for v in got.values())
    assert got[40] == want[40] and got[2000] == want[2000]
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.95


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, "x"), (1, [0.5, 0.0], 0, "x"), (20, [1.0, 2.0, 3.0], 0, "x")], VECS)
    got = [tuple(r) for r in hnsw.nearest(df).collect()]
    assert got == [(0, 1, 1, 0.5)]
    assert hnsw.nearest(df.where("false")).count() == 0


def test_recall_on_clusters_without_shards():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] * 2 + rng.normal(size=(3000, 24)) * 0.3) * rng.uniform(0.5, 2, (3000, 1))
    graph = hnsw.build(x)
    found = hnsw.search(graph, x[::50])
    score = x[::50] @ x.T
    want = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), want.tolist(), strict=True)]) >= 0.9


def test_recall_with_shards_of_production_size(spark):
    rng = np.random.default_rng(7)
    n = 2 * hnsw.SHARD_ROWS + 500
    x = (rng.normal(size=(200, 32))[rng.integers(0, 200, n)] + rng.normal(size=(n, 32)) * 0.5).astype(np.float32)
    rows = [(i, v, 0, "x") for i, v in enumerate(x.tolist())]
    got = {}
    for r in hnsw.nearest(spark.createDataFrame(rows, VECS), k=20, query_step=100, query_block=64).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows, 20, 100)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9
