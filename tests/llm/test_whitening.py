"""Whitening against exact rational sums, and the eigenvector refinement on hard matrices."""

import math
from fractions import Fraction

import numpy as np
import pytest

from hazardloom.llm import queries, whitening

SF_DIR = "/root/testdata/sf0.001"


def residuals(matrix):
    matrix = matrix.astype(np.longdouble)
    values, vectors = whitening.eigenvectors(matrix)
    norm = float(np.abs(matrix).max()) or 1.0
    assert list(values) == sorted(values, reverse=True)
    assert float(np.abs(matrix @ vectors - vectors * values).max()) / norm < 1e-17
    assert float(np.abs(vectors.T @ vectors - np.eye(len(matrix))).max()) < 1e-17
    return values, vectors


def rotation(rng, size):
    q = np.linalg.qr(rng.standard_normal((size, size)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(size) - 0.5 * q.T @ q)
    return q


def test_refinement_beyond_double():
    m = np.random.default_rng(1).standard_normal((400, 48))
    residuals(m.T @ m)


@pytest.mark.parametrize("gap", [1e-5, 1e-7, 1e-9])
def test_clustered_eigenvalues_are_told_apart(gap):
    q = rotation(np.random.default_rng(2), 40)
    d = np.ones(40, np.longdouble)
    d[:4] = [5, 4, 4 - np.longdouble(gap), 3]
    m = (q * d) @ q.T
    _, vectors = residuals((m + m.T) / 2)
    for k in range(4):
        away = min(np.abs(vectors[:, k] - sign * q[:, k]).max() for sign in (1, -1))
        assert float(away) < 1e-17 / gap


@pytest.mark.parametrize("matrix", [np.eye(6), np.zeros((3, 3)), np.diag([3.0, 0, 0, 1, 1, 1]), np.array([[2.0]]), np.ones((5, 5))])
def test_equal_and_zero_eigenvalues(matrix):
    residuals(matrix)


def test_product_of_slices_is_extended():
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((9, 30)), rng.standard_normal((30, 7)) * 10.0 ** rng.integers(-9, 9, 7)
    got = whitening.product(a.astype(np.longdouble), b.astype(np.longdouble))
    for i in range(9):
        for j in range(7):
            exact = sum(Fraction(x) * Fraction(y) for x, y in zip(a[i], b[:, j], strict=True))
            high = float(got[i, j])
            rest = Fraction(high) + Fraction(float(got[i, j] - high)) - exact
            scale = sum(abs(Fraction(x) * Fraction(y)) for x, y in zip(a[i], b[:, j], strict=True))
            assert abs(rest) <= scale / 2**58


@pytest.mark.parametrize("factor", [1, 2**30, 2**45])
def test_sums_are_exact(factor):
    x = np.random.default_rng(3).integers(-200, 200, (300, 5)) * factor
    centre = [3, -5 * factor, 0, 100, 7]
    y = x.astype(object) - np.array(centre, object)
    assert (whitening.exact_products(x, centre) == y.T.dot(y)).all()
    assert (whitening.exact_sums(x) == x.astype(object).sum(axis=0)).all()


def test_limbs_add_up():
    for v in (0, 5, -7, 2**40, -(2**70) - 3, 2**32):
        assert sum(d << (32 * p) for p, d in whitening._limbs(v)) == v


def plain(rows):
    """The contract by exact fractions; eigenvectors in double by numpy, for rows (id, vector)."""
    kept = [
        (i, tuple(math.floor(256 * float(c)) for c in v))
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = sorted({x for _, x in kept})
    n, size = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(size)]
    wide = [[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit]
    cov = np.array([[float(Fraction(sum(w[i] * w[j] for w in wide), n**3)) for j in range(size)] for i in range(size)])
    values, vectors = np.linalg.eigh(cov)
    return kept, n, sums, values[::-1], vectors[:, ::-1], np.trace(cov)


def check_against_plain(found, rows):
    kept, n, sums, values, vectors, trace = plain(rows)
    shown = min(4, len(sums))
    got = {}
    for r in found:
        got.setdefault(r.vec_id, []).append(r)
    assert sorted(got, key=str) == sorted({i for i, _ in kept}, key=str)
    assert len(found) == shown * len(kept)
    for k in range(shown):
        mine, theirs = [], []
        for i, x in kept:
            row = next(r for r in got[i] if r.component == k + 1)
            assert row.n == n
            assert row.explained == pytest.approx(values[k] / trace, rel=1e-9)
            assert row.identity_error <= 1e-9
            if len(got[i]) == shown:
                assert row.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
                mine.append(row.whitened)
                centred = [float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)]
                theirs.append(np.dot(centred, vectors[:, k]) / math.sqrt(values[k]))
        sign = 1 if np.dot(mine, theirs) > 0 else -1
        assert np.abs(np.array(mine) - sign * np.array(theirs)).max() < 1e-9


def test_query_equals_plain_version(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_against_plain(queries.op13_whitening(spark, SF_DIR).collect(), [tuple(r) for r in rows])


def test_awkward_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in rng.standard_normal(6)]) for k in range(200)]
    rows += [(300 + k, rows[7][1]) for k in range(100)]  # copies count once in the fit list
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6)]
    rows += [(None, rows[3][1]), (504, [0.0] * 6), (505, [-0.0] * 6), (9, rows[9][1])]
    ragged = [(600, [1.0, 2.0]), (601, []), (602, [1e30] * 6)]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows + ragged], "vec_id long, embedding array<float>, x string, n string")
    as_float = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    check_against_plain(whitening.whitened(table.repartition(5)).collect(), as_float)


def test_without_spread_and_empty(spark):
    kind = "vec_id long, embedding array<float>"
    same = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(same)] == [
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)
    ]
    line = whitening.whitened(spark.createDataFrame([(k, [float(k), float(k), 1.0]) for k in range(9)], kind)).collect()
    assert {r.component for r in line if r.whitened is not None} == {1}
    assert sum(r.explained for r in line if r.vec_id == 0) == pytest.approx(1)
    for none in ([], [(1, None)], [(1, [])]):
        empty = whitening.whitened(spark.createDataFrame(none, kind))
        assert empty.collect() == []
        assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
