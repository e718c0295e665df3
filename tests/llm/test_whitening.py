import numpy as np
import pytest

from mailsieve.llm import whitening


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, v, 1, 7, "c") for i, v in rows], "vec_id long, embedding array<float>, label int, n long, component string")


def expected(rows, count=8):
    """Rows as (vec_id, component) -> figures, by numpy's full eigendecomposition in exact centring."""
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in rows], dtype=object)
    n, total = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, total))) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, total)] for row in x], dtype=float)
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    return n, deviation, values[::-1][:count], axes[:, ::-1][:, :count], centred, np.trace(covariance)


def check(rows, got, count=8):
    n, deviation, values, axes, centred, trace = expected(rows, count)
    byid = {(r["vec_id"], r["component"]): r for r in got}
    assert len(byid) == len(got) == n * min(count, len(values))
    for c in range(len(values)):
        white = np.array([byid[i, c + 1]["whitened"] for i, _ in rows])
        assert white.var() == pytest.approx(1, abs=1e-9)
        plain = centred @ axes[:, c] / np.sqrt(values[c])
        assert min(np.abs(white - plain).max(), np.abs(white + plain).max()) < 1e-7
        assert byid[rows[0][0], c + 1]["explained"] == pytest.approx(values[c] / trace, rel=1e-10)
    assert [byid[i, 1]["deviation"] for i, _ in rows] == deviation
    assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in got)


@pytest.mark.parametrize("dimension,n,offset", [(64, 700, 0.0), (30, 200, 50.0), (3, 40, -1.0)])
def test_components_equal_the_full_decomposition(spark, vectors, dimension, n, offset):
    random = np.random.default_rng(dimension)
    data = random.normal(size=(n, dimension)) * 0.93 ** np.arange(dimension) @ np.linalg.qr(random.normal(size=(dimension, dimension)))[0] + offset
    rows = list(enumerate(data.astype(np.float32).tolist()))
    check(rows, whitening.whiten(vectors(rows).repartition(3)).collect())


def test_rows_that_are_no_vectors_are_dropped(spark, vectors, folder):
    random = np.random.default_rng(1)
    good = list(enumerate(random.normal(size=(50, 12)).astype(np.float32).tolist()))
    bad = [(100, None), (101, []), (102, [None] + [0.0] * 11), (103, [float("nan")] * 12), (104, [float("inf")] + [0.0] * 11), (105, [1.0] * 5),
           (106, [2e9] + [0.0] * 11)]
    check(good, whitening.op13_jacobi_davidson_whitening(spark, folder(embeddings=vectors(good + bad))).collect())


def test_tables_without_spread(spark, vectors):
    assert whitening.whiten(vectors([])).collect() == []
    assert whitening.whiten(vectors([(1, None)])).collect() == []
    assert whitening.whiten(vectors([(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(vectors([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_lower_rank_null_ids_and_repeated_rows(spark, vectors):
    random = np.random.default_rng(2)
    data = np.repeat(np.round(random.normal(size=(40, 2)) * 50)[:, [0, 1, 0, 1, 0]], 3, axis=0) / 16  # rank 2
    got = whitening.whiten(vectors([(None if k % 2 else 5, v) for k, v in enumerate(data.tolist())])).collect()
    assert len(got) == 2 * len(data) and {r["component"] for r in got} == {1, 2}
    assert sum(r["vec_id"] is None for r in got) == len(data) and got[0]["identity_error"] < 1e-9


def test_deviation_beyond_64_bits_is_null(spark, vectors):
    got = whitening.whiten(vectors([(i, [5e8 * (i % 2), float(i)]) for i in range(4)]), 1).collect()
    assert len(got) == 4 and all(r["deviation"] is None for r in got)


def test_minres_solves_indefinite_systems():
    random = np.random.default_rng(3)
    a = random.normal(size=(20, 20))
    a, right = a + a.T, random.normal(size=(20, 3))
    right[:, 1] = 0
    assert np.abs(a @ whitening.minres(lambda y: a @ y, right, 80, 1e-13) - right).max() < 1e-9


@pytest.mark.parametrize("values", [1 + np.arange(50) / 1000, np.r_[np.full(12, 5.0), np.ones(38)], np.r_[3, 2, 1, np.zeros(47)], 0.8 ** np.arange(50)])
def test_solver_on_hard_spectra(values):
    turn = np.linalg.qr(np.random.default_rng(4).normal(size=(50, 50)))[0]
    matrix = (turn * values) @ turn.T
    got, axes = whitening.jacobi_davidson(lambda y: matrix @ y, 50, 8)
    assert np.abs(got - np.sort(values)[::-1][:8]).max() < 1e-12 and np.abs(matrix @ axes - axes * got).max() < 1e-11
