import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfline.llm import ann as a

SHAPE = "vec_id long, embedding array<float>, rank int"


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for n, i in enumerate(ids):
        if i % 20 == 0:
            score = x @ x[n]
            order = [j for j in np.lexsort((ids, -score)) if j != n][:k]
            out[int(i)] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(frame, **kwargs):
    got = {}
    for r in sorted(a.nearest(frame, F.col("id") % 20 == 0, **kwargs).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("unequal", [False, True])
def test_recall_and_order(spark, unequal):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 32)).astype(np.float32) * (r.random((3000, 1)) + 0.5 if unequal else 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, 20)
    got = found(spark.createDataFrame([(i, v, 0) for i, v in rows], SHAPE), shard_rows=1000)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) > 0.95
    scores = dict(want[40])
    assert all(s == pytest.approx(scores[i], rel=1e-12) for i, s in got[40] if i in scores)
    assert all(v == sorted(v, key=lambda p: (-p[1], p[0])) for v in got.values())


@pytest.mark.parametrize("length", [1e3, 1e6, 1e18])
def test_one_long_vector(length):
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1234] *= length
    x = x.astype(np.float32)
    graph = a.Graph(x).build()
    asked = np.delete(x, 1234, axis=0)[::20].astype(float)
    found = graph.search(asked, 20, 100)
    want = np.argsort(-(asked @ x.astype(float).T), axis=1, kind="stable")[:, :20]
    hits = [len(set(f) & set(w)) / 20 for f, w in zip(found.tolist(), want.tolist(), strict=True)]
    assert np.mean(hits) > 0.95
    assert all((1234 in f) == (1234 in w) for f, w in zip(found.tolist(), want.tolist(), strict=True))


def test_copies_are_exact(spark):
    r = np.random.default_rng(2)
    one, two = r.normal(size=8).astype(np.float32), r.normal(size=8).astype(np.float32)
    rows = [(i, (one if i % 3 else two).tolist()) for i in range(400)]
    assert found(spark.createDataFrame([(i, v, 0) for i, v in rows], SHAPE)) == {
        q: [(i, pytest.approx(s)) for i, s in w] for q, w in brute(rows, 20).items()
    }


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [nan, 1.0]), (8, [inf, 1.0]),
        (9, [None, 1.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (60, None), (80, [0.0, -0.0]),
    ]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SHAPE)
    assert found(frame) == {0: [(3, 1.0), (20, 0.0)], 20: [(3, 2.0), (0, 0.0)]}
    assert found(frame.limit(0)) == {}
    assert found(frame.where("vec_id = 3")) == {}


def test_blocks_of_queries(spark):
    r = np.random.default_rng(3)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(r.normal(size=(500, 8)))]
    nodes = a.distinct_vectors(spark.createDataFrame(rows, SHAPE), 3, "vec_id", "embedding")
    index = a.build_index(nodes.select("node", "vector", "size"), shard_rows=200).cache()
    queries = nodes.select(F.col("node").alias("query"), "vector", "size")
    few, one = (a.search_index(index, queries, 5, query_rows=n) for n in (100, 1000))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, one.collect()))
