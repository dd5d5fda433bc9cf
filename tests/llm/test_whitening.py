"""Operator 12 against numpy's eigenvectors, and its exact parts against whole-number identities."""

import math
import random

import numpy as np
import pytest

from attestra.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, component string, n string, x string"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], v, 0, "a", "b", "c") for k, v in enumerate(vectors)], SCHEMA).repartition(3)


def plain(vectors):
    """x of each vector that stays; n, eigenvalues and unit eigenvectors of the covariance over distinct x."""
    longest = max((len(v) for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)), default=0)
    x = {k: [math.floor(256 * float(np.float32(c))) for c in v] for k, v in enumerate(vectors) if v and len(v) == longest and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted(set(map(tuple, x.values()))), float)
    centred = fit - fit.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, fit, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("d, n", [(3, 40), (8, 200), (17, 60)])
def test_whitening(spark, d, n):
    rng = np.random.default_rng(d)
    base = (rng.normal(size=(n, d)) * np.linspace(0.05, 0.9, d)).astype(np.float32).tolist()
    vectors = base + base[:5] + [base[0]] * 30 + [None, [], [None, *base[1][1:]], [float("nan"), *base[1][1:]], [*base[1][1:], float("inf")], base[2][:-1]]
    rows = whitening.whiten(table(spark, vectors)).collect()
    x, fit, e, u = plain(vectors)
    assert {r["vec_id"] for r in rows} == set(x) and len(rows) == len(x) * min(4, d)
    total = [sum(int(v[k]) for v in fit) for k in range(d)]
    for r in rows:
        k = r["component"] - 1
        assert r["n"] == len(fit)
        assert int(r["deviation"]) == sum((len(fit) * a - s) ** 2 for a, s in zip(x[r["vec_id"]], total))
        want = (np.array(x[r["vec_id"]]) - fit.mean(axis=0)) @ u[:, k] / math.sqrt(e[k])
        assert abs(r["whitened"]) == pytest.approx(abs(want), rel=1e-8, abs=1e-8)
        assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-10)
        assert r["identity_error"] < 1e-10
    one = {r["vec_id"]: r["whitened"] for r in rows if r["component"] == 1}
    signs = [np.sign(one[k] * ((np.array(x[k]) - fit.mean(axis=0)) @ u[:, 0])) for k in x]
    assert len(set(signs) - {0.0}) == 1


def test_equal_roots_and_low_rank(spark):
    cube = [[a, b, c, 0.5] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]  # three equal eigenvalues and a constant
    rows = whitening.whiten(table(spark, cube)).collect()
    white = {(r["vec_id"], r["component"]): r["whitened"] for r in rows}
    y = np.array([[white[k, c] for c in (1, 2, 3)] for k in range(8)])
    assert len(rows) == 24 and np.allclose(y.T @ y / 8, np.eye(3), atol=1e-14)
    assert all(r["explained"] == pytest.approx(1 / 3, rel=1e-15) and r["identity_error"] < 1e-14 for r in rows)


def test_odd_rows(spark):
    assert whitening.whiten(table(spark, [None, [], [None], [float("nan")]])).count() == 0
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 3)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    pair = whitening.whiten(table(spark, [[1.0, 2.0], [1.5, 2.0], [1.5, 2.0]], [7, None, 7])).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"], abs(r["whitened"])) for r in pair) == [(False, 7, 1.0), (False, 7, 1.0), (True, None, 1.0)]
    wide = whitening.whiten(table(spark, [[3e12, 1.0], [-1e12, 2.0], [2.5e11, -5e11]])).collect()  # sums beyond 64 bits
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in ([3e12, 1.0], [-1e12, 2.0], [2.5e11, -5e11])]
    total = [sum(v[k] for v in x) for k in (0, 1)]
    assert {(r["vec_id"], int(r["deviation"])) for r in wide} == {(k, sum((3 * a - s) ** 2 for a, s in zip(v, total))) for k, v in enumerate(x)}
    assert all(r["identity_error"] < 1e-12 for r in wide)


def test_polynomial_and_roots(spark):
    rnd = random.Random(3)
    for d in (1, 2, 5, 9):
        b = [[rnd.randint(-9, 9) for _ in range(d)] for _ in range(d + 2)]
        m = [[sum(r[i] * r[j] for r in b) for j in range(d)] for i in range(d)]
        poly = whitening.characteristic(spark, m)
        power = np.linalg.matrix_power
        assert poly[-1] == 1 and poly[-2] == -sum(m[i][i] for i in range(d))
        assert not sum(c * power(np.array(m, object), k) if k else c * np.eye(d, dtype=int).astype(object) for k, c in enumerate(poly)).any()  # every matrix solves its polynomial
        roots = [whitening.root(poly, k) for k in range(1, d + 1)]
        assert np.allclose([at / 2**bits for at, bits, _ in roots], np.linalg.eigvalsh(np.array(m, float))[::-1])
    assert [whitening.root([-12, 16, -7, 1], k)[2] for k in (1, 2, 3)] == [1, 1, 2]  # (t - 2)^2 (t - 3)


def test_polynomial_modulo_small_primes():
    rnd = random.Random(5)
    for d in (3, 6):
        m = [[rnd.choice([0, 0, 1, 5, -3]) for _ in range(d)] for _ in range(d)]  # zeros: pivots must be looked for
        exact = np.rint(np.poly(np.array(m, float)))[::-1].astype(int).tolist()
        for p in (101, 2_147_483_647):
            assert whitening.polynomial_mod(np.array(m), p).tolist() == [c % p for c in exact]
    primes = whitening.primes_below(1 << 31, 1 << 100)
    for value in (0, -5, 7, -(1 << 90), 1 << 95):
        assert whitening.remaindered([value % p for p in primes], primes) == value
    assert primes[0] == 2_147_483_647 and [p for p in range(3, 200) if p > 7 and whitening._is_prime(p)] == [p for p in range(11, 200) if all(p % k for k in range(2, p))]
