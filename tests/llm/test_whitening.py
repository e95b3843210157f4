import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfline.llm import whitening as w


def scatter_of(rows):
    """n, sums and n * sum(x x') - S S' of the distinct rows, in Python integers."""
    fit = sorted(set(map(tuple, rows)))
    n, d = len(fit), len(fit[0])
    s = [sum(r[i] for r in fit) for i in range(d)]
    return n, s, np.array([[n * sum(r[i] * r[j] for r in fit) - s[i] * s[j] for j in range(d)] for i in range(d)], object)


def by_traces(matrix):
    """Characteristic polynomial, lowest first, by Faddeev and LeVerrier's recursion in fractions."""
    d = len(matrix)
    a = [[Fraction(int(x)) for x in row] for row in matrix]
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        am = [sum(a[i][t] * m[t][i] for t in range(d)) for i in range(d)]
        c.append(-sum(am) / k)
    return [int(x) for x in reversed(c)]


def rows_of(seed, n, d, spread=40):
    r = np.random.default_rng(seed)
    return (r.integers(-spread, spread, (n, d)) * r.integers(1, 5, d)).tolist()


@pytest.mark.parametrize(("n", "d"), [(30, 6), (4, 6), (9, 1), (40, 12)])
def test_polynomial_equals_recursion(spark, n, d):
    matrix = scatter_of(rows_of(n + d, n, d))[2]
    assert w.characteristic_polynomial(spark, matrix) == by_traces(matrix)


def test_polynomial_of_sparse_and_repeated(spark):
    matrix = np.array([[int(x) for x in row] for row in np.diag([5, 5, 0, 2, 5, 0])], object)
    assert w.characteristic_polynomial(spark, matrix) == by_traces(matrix)
    pairs = w.eigenpairs(spark, matrix)
    assert [round(e, 9) for e, _ in pairs] == [5, 5, 5, 2]
    v = np.array([v for _, v in pairs])
    assert np.abs(v @ v.T - np.eye(4)).max() < 1e-14
    assert np.abs(v[:3, [2, 3, 5]]).max() < 1e-14


def test_close_eigenvalues_have_exact_vectors(spark):
    # two eigenvalues that differ by one part in 10^30: far beyond double precision
    big = 10**30
    matrix = np.array([[big + 1, 0, 0], [0, big, 0], [0, 0, 3]], object)
    vectors = np.abs([v for _, v in w.eigenpairs(spark, matrix)])
    assert np.abs(vectors - np.eye(3)).max() < 1e-15


def test_root_counts():
    polynomial = [24, -62, 53, -16, 1]  # (x - 1)^2 (x - 2) (x - 12)
    assert [w.roots_above(polynomial, a, 1) for a in (0, 1, 2, 3, 4, 23, 24)] == [4, 4, 2, 2, 1, 1, 0]
    found, places = w.eigenvalues(polynomial, 16, 40)
    assert [m for _, m in found] == [1, 1, 2]
    assert [(2 * a + 1) / 2 ** (places + 1) for a, _ in found] == pytest.approx([12, 2, 1])


@pytest.mark.parametrize("size", [10, 10**6, 2**31, 2**60])
def test_products_are_exact(size):
    r = np.random.default_rng(1)
    rows = r.integers(-size, size, (50, 4))
    exact = rows.astype(object)
    assert (w.products(rows) == exact.T @ exact).all()


def brute_force(vectors, k=16):
    kept = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    rows = [[math.floor(64 * c) + 1_000_000 for c in v] for v in kept]
    fit = np.array(sorted(set(map(tuple, rows))), float)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    keep = [i for i in range(min(k, len(e))) if e[i] > 1e-9 * e[0]]
    n, s = len(fit), [sum(int(x) for x in c) for c in fit.T]
    deviation = [sum((n * x - t) ** 2 for x, t in zip(r, s, strict=True)) for r in rows]
    white = (np.array(rows) - fit.mean(axis=0)) @ u[:, keep] / np.sqrt(e[keep])
    return n, deviation, white, e[keep] / e.sum()


@pytest.mark.parametrize("d", [3, 20])
def test_whitening_equals_brute_force(spark, d):
    r = np.random.default_rng(d)
    vectors = (r.normal(size=(150, d)) * np.linspace(0.5, 2, d)).tolist() + [[0.25] * d] * 30
    bad = [None, [], [1.0] * (d + 1), [None] + [1.0] * (d - 1), [float("nan")] + [1.0] * (d - 1), [float("inf")] + [0.0] * (d - 1)]
    table = list(enumerate(vectors)) + [(1000 + i, v) for i, v in enumerate(bad)]
    docs = spark.createDataFrame(table, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit("x"))
    out = w.whiten(docs.repartition(4)).orderBy("id", "component").collect()
    n, deviation, white, explained = brute_force(vectors)
    k = len(explained)
    assert [(x["id"], x["component"], x["n"], x["deviation"]) for x in out] == [
        (i, c + 1, n, deviation[i]) for i in range(len(vectors)) for c in range(k)
    ]
    got = np.array([x["whitened"] for x in out]).reshape(-1, k)
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-9
    assert np.allclose([x["explained"] for x in out[:k]], explained, rtol=1e-10)
    assert {x["identity_error"] for x in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-9


def test_edge_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3, [(1, []), (2, [])]):
        assert w.whiten(spark.createDataFrame(rows, schema)).collect() == []
    same = w.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0])], schema)).collect()
    assert [(r["id"], r["component"], r["n"], abs(round(r["whitened"], 9))) for r in same] == [(None, 1, 2, 1.0), (2, 1, 2, 1.0), (2, 1, 2, 1.0)]


def test_huge_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, 2.0])]
    out = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    # sums are 32, 64 * 3 and n is 3: the third row is near the mean, the others beyond a long
    assert len(out) == 6 and {(r["id"], r["deviation"]) for r in out} == {(1, None), (2, None), (3, 64**2 + 192**2)}
    assert out[0]["identity_error"] < 1e-4
