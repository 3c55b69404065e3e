"""Exact whitening against exact determinants, numpy and plain Python sums."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from kerbside.llm import charpoly, whitening
from kerbside.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def determinant(rows):
    a, sign = [[Fraction(x) for x in r] for r in rows], 1
    for k in range(len(a)):
        r = next((i for i in range(k, len(a)) if a[i][k]), None)
        if r is None:
            return 0
        if r != k:
            a[k], a[r], sign = a[r], a[k], -sign
        for i in range(k + 1, len(a)):
            f = a[i][k] / a[k][k]
            a[i] = [x - f * y for x, y in zip(a[i], a[k])]
    return sign * math.prod(a[i][i] for i in range(len(a)))


def polynomial(matrix):
    exact, trace = np.array(matrix, dtype=object), sum(matrix[i][i] for i in range(len(matrix)))
    return charpoly.combine({p: charpoly.polynomial_modulo((exact % p).astype(np.int64), p) for p in charpoly.primes_for(len(matrix), trace)})


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6).flatmap(lambda d: st.lists(st.lists(st.integers(-(10**6), 10**6), min_size=d, max_size=d), min_size=1, max_size=8)))
def test_polynomial_is_the_determinant(rows):
    x = np.array(rows, dtype=object)
    matrix = (x.T @ x).tolist()
    found = polynomial(matrix)
    for place in (-3, 0, 1, 10**7):
        shifted = [[place * (i == j) - v for j, v in enumerate(r)] for i, r in enumerate(matrix)]
        assert sum(c * place**i for i, c in enumerate(found)) == determinant(shifted)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 1, 2, 3, 1000, 1001, 10**12, 10**12 + 1]), min_size=1, max_size=9), st.integers(1, 9))
def test_roots_with_multiplicities(roots, count):
    c = [1]
    for r in roots:
        c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
    found = charpoly.RealRoots(c).largest(count)
    distinct = sorted({r for r in roots if r}, reverse=True)[: len(found)]
    assert [m for _, m in found] == [roots.count(r) for r in distinct]
    assert all(abs(a / b - 1) < Fraction(1, 1 << 120) for (a, _), b in zip(found, distinct))
    assert sum(m for _, m in found) >= min(count, sum(r > 0 for r in roots))


def test_null_vectors_of_close_and_multiple_roots():
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (300, 12)).astype(object)
    matrix = (x.T @ x).tolist()
    for root, m in charpoly.RealRoots(polynomial(matrix)).largest(12):
        [v] = charpoly.null_vectors(matrix, root, m)
        off = np.array(matrix, dtype=float) @ v - float(root) * np.array(v)
        assert np.abs(off).max() < 1e-13 * float(root) * 10 and abs(np.dot(v, v) - 1) < 1e-15
    double = [[5, 0, 0], [0, 5, 0], [0, 0, 2]]
    (root, m), (last, one) = charpoly.RealRoots(polynomial(double)).largest(3)
    v = np.array(charpoly.null_vectors(double, root, m))
    assert (m, one) == (2, 1) and abs(float(root) - 5) < 1e-15 and np.allclose(v @ v.T, np.eye(2), atol=1e-15) and np.abs(v[:, 2]).max() < 1e-15


@given(st.lists(st.lists(st.integers(-(1 << 53), 1 << 53), min_size=3, max_size=3), min_size=1, max_size=5))
def test_products_are_exact(rows):
    x = np.array(rows, dtype=np.int64)
    wide = x.astype(object)
    assert whitening._gram(np.repeat(x, 700, axis=0)).tolist() == (700 * (wide.T @ wide)).tolist()


def scaled(vector):
    return tuple(math.floor(64 * float(np.float64(c))) + 1_000_000 for c in vector)


def check(rows, found):
    """rows: vec_id -> usable vector; found: rows of the query's columns."""
    x = {i: scaled(v) for i, v in rows.items()}
    fit = sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    a = np.array(fit, dtype=float)
    centred = a - np.array([s / n for s in sums])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    assert len(found) == len(x) * len(values)
    by_id = {}
    for r in found:
        i, component, m, deviation, white, explained, error = r
        assert m == n and deviation == sum((n * a - s) ** 2 for a, s in zip(x[i], sums)) and error < 1e-9
        assert abs(explained / (values[component - 1] / np.trace(covariance)) - 1) < 1e-9
        by_id.setdefault(i, {})[component] = white
    ids = sorted(by_id)
    z = np.array([[by_id[i][k + 1] for k in range(len(values))] for i in ids])
    theirs = (np.array([x[i] for i in ids]) - np.array(sums) / n) @ vectors / np.sqrt(values)
    signs = np.sign((z * theirs).sum(axis=0))
    assert np.abs(z - signs * theirs).max() < 1e-7


COLUMNS = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def test_query(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check(rows, [tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_whitening"](spark, SF).collect()])


def whiten(df, most=16):
    model = whitening.fit(df, most)
    return model, whitening.transform(df, model)


SCHEMA = "vec_id bigint, embedding array<double>, x int, dims int, k0 string, deviation int, `odd.x` int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, "k", 3, 4) for i, v in vectors], SCHEMA)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.standard_normal(3).tolist()) for i in range(40)]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 1.0, 2.0]), (55, [1.0, 2.0])]
    model, found = whiten(frame(spark, good + odd + good[:20] + [(None, good[0][1])]))
    assert found.columns == ["vec_id", "embedding", "x", "dims", "k0", "odd.x", "deviation", "whitened"]
    assert model.n == len({scaled(v) for _, v in good}) and len(model.values) == 3 and model.identity_error < 1e-12
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in found.collect()) == sorted([(False, i) for i, _ in good + good[:20]] + [(True, 0)])
    same = {}
    for r in found.collect():
        assert same.setdefault(r.vec_id, r.whitened) == r.whitened


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_nothing_to_whiten(spark, vectors):
    model, found = whiten(frame(spark, vectors))
    assert model.values == [] and all(r.whitened == [] for r in found.collect())


def test_ranks_below_the_dimensions_and_huge_entries(spark):
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]
    model, found = whiten(frame(spark, line))
    assert len(model.values) == 1 and abs(model.explained[0] - 1) < 1e-15 and model.identity_error < 1e-12
    huge = [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [3.0, 4.0])]
    model, found = whiten(frame(spark, huge))
    # entries of 1e300 stay at 2**52, so the third vector lies near the mean
    assert len(model.values) == 2 and abs(sum(model.explained) - 1) < 1e-15 and model.identity_error < 1e-4
    assert [r.deviation for r in found.collect()] == [None, None, 249856]
