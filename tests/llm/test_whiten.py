import numpy as np
import pytest

from aqengine.llm import whiten

SCHEMA = "vec_id long, embedding array<double>, component int, x binary, n long"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, None if v is None else list(map(lambda c: None if c is None else float(c), v)), 9, b"", 1) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], SCHEMA)


def exact(vectors, k=8):
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    z = x - s / n
    e, u = np.linalg.eigh(z.T @ z / n)
    return x, s, e[::-1][:k], u[:, ::-1][:, :k], e.sum()


@pytest.mark.parametrize(("n", "dim"), [(900, 64), (300, 5), (60, 40)])
def test_equals_a_full_decomposition(spark, n, dim):
    r = np.random.default_rng(dim)
    vectors = r.standard_normal((n, dim)) / 8
    vectors[:, 0] += (np.arange(n) % 3) / 2
    x, s, e, u, whole = exact(vectors)
    rows = whiten.whitened(frame(spark, vectors)).toPandas().sort_values(["vec_id", "component"])
    k = min(8, dim)
    got = rows.whitened.to_numpy().reshape(n, k)
    want = (x - s / n) @ u / np.sqrt(e)
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-7
    assert np.abs(rows.explained.to_numpy().reshape(n, k)[0] / (e / whole) - 1).max() < 1e-10 and rows.identity_error.max() < 1e-9
    assert rows.deviation.tolist() == np.repeat([sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x], k).tolist()


def test_close_eigenvalues_and_few_vectors(spark):
    """Fewer vectors than dimensions, and a spectrum without any gap."""
    r = np.random.default_rng(1)
    few = np.linalg.qr(r.standard_normal((80, 30)))[0].T
    rows = whiten.whitened(frame(spark, few)).toPandas()
    x, s, e, u, whole = exact(few)
    assert np.abs(rows.groupby("component").explained.first().to_numpy() / (e / whole) - 1).max() < 1e-4 and rows.identity_error.max() < 1e-4


def test_odd_rows(spark):
    good = [[0.1 * i, -0.2 * i * i, 0.3] for i in range(12)]
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0], [1e300, 0.0, 0.0]]
    rows = whiten.whitened(frame(spark, good + odd, [None, 1, 1, *range(3, 12), *range(50, 57)])).toPandas()
    x, s, e, u, whole = exact(good)
    assert len(rows) == 12 * 3 and rows.vec_id.isna().sum() == 3 and (rows.vec_id == 1).sum() == 6 and (rows.n == 12).all()
    flat = rows[rows.component == 3]  # the third entry never changes
    assert (flat.whitened == 0).all() and (flat.explained == 0).all() and (rows.identity_error == 1).all()
    assert np.allclose(sorted(set(rows.explained.round(9))), sorted({0.0, *(e[:2] / whole).round(9)}))
    assert whiten.whitened(frame(spark, [])).collect() == [] and whiten.whitened(frame(spark, odd[:2])).collect() == []
    assert {r["whitened"] for r in whiten.whitened(frame(spark, [[1.0, 2.0]] * 3)).collect()} == {0.0}


def test_deviations_beyond_a_double_and_beyond_a_long():
    x = np.array([[2**45 + 3, 1], [5, 2]], np.int64)
    assert whiten._deviations(x, 2, np.array([0, 0]), np.array([7, 1])) == [None, 18]
    x = np.array([[40_000_001, 3]], np.int64)
    assert whiten._deviations(x, 70, np.zeros(2, np.int64), np.zeros(2, np.int64)) == [(70 * 40_000_001) ** 2 + 210**2]
