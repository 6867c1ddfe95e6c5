"""Whitening against numpy's eigendecomposition."""

import numpy as np
import pytest

from annalist.llm import queries, whitening
from annalist.llm.whitening import Spectrum


@pytest.mark.parametrize("seed", range(6))
def test_secular_roots(seed):
    rng = np.random.default_rng(seed)
    d = np.sort(rng.random(30)) * 10.0 ** rng.integers(-3, 4)
    z = rng.normal(size=30) * 10.0 ** rng.integers(-4, 1, 30)
    roots, gaps = whitening.secular_roots(d, z * z)
    assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)), rtol=1e-12, atol=1e-13 * roots[-1])
    assert np.allclose(gaps, d[None, :] - roots[:, None], atol=1e-12 * roots[-1])
    assert (gaps[np.tril_indices(30)] < 0).all() and (gaps[np.triu_indices(30, 1)] > 0).all()


def scatter(x):
    return (x - x.mean(0)).T @ (x - x.mean(0))


@pytest.mark.parametrize("kind", ["plain", "copies", "flat", "few", "equal"])
def test_spectrum_of_rows_and_merge(kind):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(400, 12)) * [1, 2, 3, 4, 5, 6, 7, 8, 9, 30, 30, 1000])
    if kind == "copies":
        x[::3] = x[0]
    if kind == "flat":
        x[:, 4:9] = 7
    if kind == "few":
        x = x[:5]
    if kind == "equal":
        x[:] = x[0]
    whole, left, right = Spectrum(12), Spectrum(12), Spectrum(12)
    for k, row in enumerate(x):
        whole.add_row(row)
        (left if k % 3 else right).add_row(row)
    left.merge(right)
    for s in (whole, left):
        assert s.n == len(x) and np.allclose(s.mean, x.mean(0))
        assert np.allclose(s.vectors.T @ s.vectors, np.eye(12), atol=1e-11)
        assert np.allclose(s.vectors * s.values @ s.vectors.T, scatter(x), atol=1e-9 * max(1.0, np.abs(scatter(x)).max()))


def plain(x):
    """Eigenvalues, explained shares and whitened values, falling."""
    v = scatter(x.astype(float)) / len(x)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return e, (x - x.mean(0)) @ u / np.sqrt(np.maximum(e, 1e-300))


def check(got, ids, x, most=32):
    n, sums = len(x), x.sum(0)
    e, w = plain(x)
    k = min(most, x.shape[1])
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(rows) == n * k
    for c in range(k):
        column = np.array([rows[i, c + 1].whitened for i in ids])
        sign = np.sign(column @ w[:, c])
        assert np.allclose(column * sign, w[:, c], atol=1e-7)
        assert rows[ids[0], c + 1].explained == pytest.approx(e[c] / e.sum(), rel=1e-10)
    for i, row in zip(ids, x):
        assert rows[i, 1].deviation == int(((n * row.astype(object) - sums.astype(object)) ** 2).sum())
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(table.embedding).astype(np.float64)).astype(np.int64) + 1_000_000
    check(queries.QUERIES["op13_whitening"](spark, sf).collect(), table.vec_id.tolist(), x)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(90, 5)).round(3)
    vectors[60:] = vectors[3]
    odd = [None, [], [1.0, None, 1.0, 1.0, 1.0], [1.0, float("nan"), 1.0, 1.0, 1.0], [float("inf")] * 5, [1e300] * 5, [1.0, 2.0]]
    rows = [(k, v.tolist(), 9, "x") for k, v in enumerate(vectors)] + [(1000 + k, v, 9, "x") for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, state string").repartition(11)
    fine = whitening.quantised(df, "embedding", 64, 10)
    model = whitening.fit(fine, most=4)
    check(whitening.whiten(fine, model).collect(), list(range(90)), np.floor(64 * vectors).astype(np.int64) + 10, most=4)
    same = fine.filter("vec_id >= 60 AND vec_id < 90")
    assert whitening.whiten(same, whitening.fit(same)).count() == 0
    none = fine.limit(0)
    assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
    null_id = spark.createDataFrame([(None, [1, 2]), (1, [4, -2])], "vec_id long, x array<bigint>")
    assert {r.vec_id for r in whitening.whiten(null_id, whitening.fit(null_id)).collect()} == {None, 1}


def test_large_sums():
    x = np.array([[2**40, -(2**40)], [2**40 - 1, 5]])
    n, sums = 2**33, [2**60, 3]
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, n, sums) == [w if w < 2**63 else None for w in want]
