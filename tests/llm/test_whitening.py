"""Whitening: exact arithmetic, the polynomial, roots and components against plain versions; odd tables."""

from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from sectorscope.llm import whitening as W
from sectorscope.llm.queries import op12_whitening


def _plain_polynomial(m: np.ndarray) -> list[int]:
    """Faddeev-LeVerrier, constant term first."""
    d = len(m)
    c, aux = [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        aux = m.dot(aux) + c[-1] * np.eye(d, dtype=int).astype(object)
        c.append(int(-Fraction(int(np.trace(m.dot(aux))), k)))
    return c[::-1]


def _scatter(rng, n, d, top):
    x = rng.integers(-top, top, (n, d)).astype(object)
    return n * x.T.dot(x) - np.outer(x.sum(0), x.sum(0))


@pytest.mark.parametrize("top", [5, 1 << 12, 1 << 25, 1 << 61])
def test_exact_gram(top):
    m = np.random.default_rng(top % 97).integers(-top, top, (300, 4))
    big = m.astype(object)
    assert (W.exact_gram(m) == big.T.dot(big)).all()


@pytest.mark.parametrize("n,top", [(7, 3), (2_000, 900), (3_000_000, 1 << 20), (10, 1 << 58)])
def test_deviations(n, top):
    rng = np.random.default_rng(n)
    off, rest = rng.integers(-top, top, (20, 6)), rng.integers(0, n, 6).tolist()
    assert W.deviations(off, n, rest) == [sum((n * int(c) - r) ** 2 for c, r in zip(row, rest)) for row in off]


@pytest.mark.parametrize("n,d", [(30, 1), (30, 2), (40, 7), (4, 7)])
def test_characteristic_polynomial(spark, n, d):
    m = _scatter(np.random.default_rng(d), n, d, 500)
    assert W.characteristic_polynomial(spark, m) == _plain_polynomial(m)


def test_polynomial_with_zero_columns():
    m = np.array([[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 0, 0], [1, 0, 0, 2]], object)
    p = W.primes_below(1 << 31, 1 << 40)
    assert W.remainders_to_integers(p, W.polynomials_mod(m, p).astype(object)) == _plain_polynomial(m)


def test_primes():
    found = W.primes_below(200, 1 << 70)
    assert found == [p for p in range(199, found[-1] - 1, -1) if all(p % q for q in range(2, p))]


def test_roots_with_multiplicity():
    poly = np.array([1], object)
    for r in (0, 3, 3, 3, 10, 10, 7):
        poly = np.convolve(poly, np.array([-r, 1], object))  # constant term first
    roots, scale = W.largest_roots(poly.tolist(), 5, 128)
    assert [(round(r / 2 ** scale, 20), m) for r, m in roots] == [(10, 2), (7, 1), (3, 3)]
    assert W.roots_above(poly.tolist(), 3) == 3 and W.roots_above(poly.tolist(), 2) == 6


def test_components_of_repeated_roots():
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(5, 5)))
    m = np.diag([9, 9, 4, 4, 1]).astype(object)  # repeated roots, then in another basis
    h = np.eye(5, dtype=int) * 5 - 2  # a scaled reflection: h @ h.T = 25
    m = h.astype(object).dot(m).dot(h.T.astype(object))
    roots, scale = W.largest_roots(_plain_polynomial(m), 5, 128)
    vectors = np.array([v for r, k in roots for v in W.null_vectors(m, r, scale, k, 128)])
    assert [k for _, k in roots] == [2, 2, 1]
    assert np.abs(vectors @ vectors.T - np.eye(5)).max() < 1e-14
    assert np.abs(vectors @ m.astype(float) @ vectors.T - np.diag([225, 225, 100, 100, 25])).max() < 1e-11


def test_query_against_numpy(spark):
    out = op12_whitening(spark, "/root/testdata/sf0.001").toPandas()
    table = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pydict()
    x = np.floor(1024 * np.array(table["embedding"], float)) + 100_000
    n = len(x)
    c = x - x.mean(0)
    e, v = np.linalg.eigh(c.T @ c / n)
    want = c @ v[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])
    got = np.array([out[out.component == k].set_index("vec_id").loc[table["vec_id"]].whitened for k in range(1, 9)]).T
    signs = np.sign((got * want).sum(0))
    assert np.abs(got - want * signs).max() < 1e-9
    assert (out.n == n).all() and (out.identity_error < 1e-10).all() and len(out) == 8 * n
    assert np.allclose(out.groupby("component").explained.first(), e[::-1][:8] / e.sum(), rtol=1e-12)
    big = x.astype(np.int64).astype(object)
    want = ((n * big - big.sum(0)) ** 2).sum(1)
    assert dict(zip(out.vec_id, out.deviation)) == dict(zip(table["vec_id"], want))


def _whiten(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, row int, x string")
    return W.whiten(df, carry=("vec_id", "n"), **kw).collect()


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), float(i * i % 7), 0.5], "a", 1, "b") for i in range(20)]
    bad = [(100, None, "a", 1, "b"), (101, [1.0, None, 2.0], "a", 1, "b"), (102, [nan, 0.0, 0.0], "a", 1, "b"),
           (103, [inf, 0.0, 0.0], None, None, None), (104, [1.0], "a", 1, "b"), (105, [], "a", 1, "b"), (106, [1e300, 0.0, 0.0], "a", 1, "b")]
    out = _whiten(spark, good + bad + [(None, [9.0, 9.0, 0.5], None, None, None), (3, good[3][1], "a", 1, "b")])
    assert {r.component for r in out} == {1, 2}  # the third entry is constant
    assert {r.n for r in out} == {22} and sum(r.row.vec_id == 3 for r in out) == 4 and sum(r.row.vec_id is None for r in out) == 2
    assert max(r.identity_error for r in out) < 1e-12 and abs(sum({r.component: r.explained for r in out}.values()) - 1) < 1e-12
    assert _whiten(spark, good[:1]) == [] and _whiten(spark, good[:1] * 5) == []  # no spread
    assert _whiten(spark, bad[:4]) == []
    assert W.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    two = _whiten(spark, good[:2])
    assert {r.component for r in two} == {1} and sorted(round(r.whitened, 9) for r in two) == [-1.0, 1.0]
    with pytest.raises(ValueError):
        _whiten(spark, good, rules=W.WhitenRules(max_dim=2))


def test_large_entries(spark):
    rows = [(i, [float(i) * 2.0 ** 45, float(-i * i) * 2.0 ** 40, 1.0 / (i + 1)], "a", 1, "b") for i in range(9)]
    out = _whiten(spark, rows)
    assert {r.component for r in out} == {1, 2, 3} and max(r.identity_error for r in out) < 1e-9
