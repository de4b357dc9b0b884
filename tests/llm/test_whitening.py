"""Eigenpairs against NumPy, whitening against brute force in exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from llm_tables import bench_rows, benchmark, empty, messy, rows  # noqa: F401  (fixtures)

from bagframe.llm.eigen import below, inverse_iteration, largest, leading, tridiagonal

SCHEMA = "vec_id long, embedding array<float>, v string, dim int, k string, `a.b` int, component int, whitened string"


def _symmetric(kind, n, rng):
    if kind == "clusters":
        q = np.linalg.qr(rng.normal(size=(n, n)))[0]
        a = q @ np.diag([5.0] * (n // 3) + [5.0 - 1e-9] * (n // 3) + [1.0] * (n - 2 * (n // 3))) @ q.T
    elif kind == "diagonal":
        a = np.diag([3.0] * (n // 2) + [float(i) for i in range(n - n // 2)])
    elif kind == "graded":
        q = np.linalg.qr(rng.normal(size=(n, n)))[0]
        a = q @ np.diag(10.0 ** np.linspace(8, -8, n)) @ q.T
    elif kind == "zero":
        a = np.zeros((n, n))
    else:
        a = rng.normal(size=(n + 9, n))
        a = a.T @ a
    return (a + a.T) / 2


@pytest.mark.parametrize("kind", ["random", "clusters", "diagonal", "graded", "zero"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigenpairs(kind, n):
    a = _symmetric(kind, n, np.random.default_rng(n))
    values, z = leading(a, 32)
    k, norm = min(32, n), max(1e-280, np.abs(a).max() * n)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() <= 1e-13 * norm
    assert np.abs(z.T @ z - np.eye(k)).max() < 1e-12
    assert np.abs(a @ z - z * values).max() <= 1e-12 * norm


def test_parts_of_the_solver():
    a = _symmetric("random", 20, np.random.default_rng(3))
    d, e, _ = tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    want = np.linalg.eigvalsh(a)
    assert np.allclose(np.linalg.eigvalsh(t), want, atol=1e-12 * want[-1])
    assert below(d, e, (want[1:] + want[:-1]) / 2).tolist() == list(range(1, 20))
    assert np.allclose(largest(d, e, 20)[::-1], want, atol=1e-12 * want[-1])
    z = inverse_iteration(d, e, largest(d, e, 20))
    assert np.allclose(z.T @ z, np.eye(20), atol=1e-12)


def _vectors():
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6) @ np.diag([3, 2, 1, 1, 0.5, 0.1])]) for i in range(150)]
    rows += [(None, [0.5] * 6), (7, [0.5] * 6), (7, [0.5] * 6), (7, [0.25] * 6), (200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (203, [math.nan] * 6), (204, [math.inf] + [0.0] * 5), (205, [-math.inf] * 6), (206, [1.0, 2.0]), (207, [3e38] * 6)]
    return [(i, v, "v", 9, "k", 1, 2, "w") for i, v in rows]


def _brute(rows):
    """(n, dim sums, rows with (id, deviation, x))."""
    xs = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, *_ in rows
          if v is not None and len(v) == 6 and all(c is not None and math.isfinite(c) and abs(c) < 1e17 for c in v)]
    n = len(xs)
    s = [sum(x[j] for _, x in xs) for j in range(6)]
    return n, s, [(i, sum((n * c - t) ** 2 for c, t in zip(x, s)), x) for i, x in xs]


def test_whitening_against_brute_force(spark):
    from bagframe.llm.whitening import whitened_components

    rows = _vectors()
    got = whitened_components(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    n, s, want = _brute(rows)
    x = np.array([[float(Fraction(c) - Fraction(t, n)) for c, t in zip(row, s)] for _, _, row in want])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = x @ vectors / np.sqrt(values)
    assert len(got) == n * 6 and {r.n for r in got} == {n}
    for c in range(6):
        mine = sorted(((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in got if r.component == c + 1))
        sign = {tuple(k[:3]): w for *k, w in mine}
        there = sorted(((i is None, i or 0, dev, w) for (i, dev, _), w in zip(want, white[:, c])))
        flip = np.sign(sum(a[3] * b[3] for a, b in zip(mine, there)))
        assert len(sign) > 100 and [a[:3] for a in mine] == [b[:3] for b in there]
        assert np.allclose(sorted(a[3] for a in mine), sorted(flip * b[3] for b in there), atol=1e-9)
        assert all(abs(r.explained - values[c] / values.sum()) < 1e-12 for r in got if r.component == c + 1)
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() < 1e-9


def test_few_equal_or_no_vectors(spark):
    from bagframe.llm.whitening import fit, whitened, whitened_components

    make = lambda rows: spark.createDataFrame([(i, v, "v", 9, "k", 1, 2, "w") for i, v in rows], SCHEMA)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 5):
        found = whitened_components(make(rows))
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0
    three = make([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])])
    assert sorted((r.vec_id, r.component) for r in whitened_components(three).collect()) == [(i, c) for i in (1, 2, 3) for c in (1, 2)]
    assert whitened(three, fit(three, most=1)).columns == ["vec_id", "deviation", "whitened"]
    huge = make([(1, [2.0 ** 50, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 2.0])])
    assert {r.deviation for r in whitened_components(huge).collect()} == {None}


def test_whitening_query(spark):
    from bagframe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    found = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    fine = [(i, v) for i, v in found if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    got = QUERIES["op13_embedding_whitening"](spark, sf).collect()
    x = np.array([[math.floor(64 * c) for c in v] for _, v in fine], float)
    assert len(got) == len(fine) * min(32, x.shape[1]) and {r.component for r in got} == set(range(1, min(32, x.shape[1]) + 1))
    x -= x.mean(axis=0)
    values = np.linalg.eigvalsh(x.T @ x / len(x))[::-1]
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-6 for r in got)
    n, exact = len(fine), np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in fine], object)
    s = exact.sum(axis=0)
    deviation = {(i, int(d)) for (i, _), d in zip(fine, ((exact * n - s) ** 2).sum(axis=1))}
    assert {(r.vec_id, r.deviation) for r in got} == deviation
