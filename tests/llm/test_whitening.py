"""Whitening against dense numpy eigenvectors and exact integer arithmetic."""

import numpy as np
import pytest

from skewlens.llm import whitening


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def run(df, k=8):
    return whitening.whiten(whitening.fixed_point(df, "embedding"), "embedding", "vec_id", k).collect()


def dense(vectors):
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, turns = np.linalg.eigh(centred.T @ centred / n)
    return x, n, total, centred, values[::-1], turns[:, ::-1]


def compare(rows, vectors, ids, k=8):
    x, n, total, centred, values, turns = dense(vectors)
    k = min(k, int((values > 1e-13 * values[0]).sum()))
    assert len(rows) == n * k
    by = {}
    for r in rows:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    apart = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total)) for row in x]
    for c in range(1, k + 1):
        got = np.array([by[c][i]["whitened"] for i in ids])
        want = centred @ turns[:, c - 1] / np.sqrt(values[c - 1])
        sign = 1 if got @ want > 0 else -1
        assert np.abs(sign * got - want).max() < 1e-8
        assert abs(by[c][ids[0]]["explained"] * values.sum() / values[c - 1] - 1) < 1e-12
    for i, a in zip(ids, apart):
        assert by[1][i]["deviation"] == a and by[1][i]["n"] == n
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]}
    assert rows[0]["identity_error"] < 1e-12


def test_given_vectors(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    compare(run(df), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_separate_values(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((400, 30)) * 0.5 ** np.arange(30)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(vectors)]
    compare(run(frame(spark, rows)), [r[1] for r in rows], range(400))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(90, None), (91, []), (92, [1.0, None]), (93, [nan, 1.0]), (94, [inf, 0.0]), (95, [1.0])]
    good = [(1, [0.5, 1.0]), (2, [2.0, -1.0]), (3, [2.0, -1.0]), (4, [0.25, 7.0])]
    df = frame(spark, odd + good, "double").selectExpr("*", "'x' AS n", "'x' AS component", "'x' AS data")
    compare(run(df), [v for _, v in good], [i for i, _ in good])
    ids = [r["vec_id"] for r in run(frame(spark, [(None, [0.0, 1.0]), (7, [3.0, 0.0]), (7, [3.0, 0.0])]))]
    assert sorted(ids, key=str) == [7, 7, None]  # one component with variance
    assert run(df.limit(0)) == [] and run(frame(spark, odd[:2])) == []
    assert run(frame(spark, [(1, [1.0, 2.0])] * 5)) == []  # no variance


def test_jacobi_davidson_keeps_order_and_precision():
    rng = np.random.default_rng(8)
    for d, k, spread in ((1, 8, 1.0), (5, 8, 0.5), (200, 8, 0.98), (200, 3, 0.9), (120, 5, 1.0)):
        basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
        values = spread ** np.arange(d) if spread < 1 else np.repeat([2.0, 1.0], [(d + 1) // 2, d // 2])
        matrix = (basis * values) @ basis.T
        found = whitening.jacobi_davidson(lambda v: matrix @ v, d, k)
        want = np.linalg.eigvalsh(matrix)[::-1][: min(k, d)]
        assert np.abs(found.values - want).max() < 1e-13 * want[0] * 10
        assert found.residuals.max() < 1e-12 * want[0]


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(9)
    basis = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    matrix = (basis * np.linspace(1, 3, 40)) @ basis.T
    rhs = rng.standard_normal((40, 3))
    shifts = np.array([0.5, 1.7, 2.01])
    x = whitening.minres(lambda v: matrix @ v, shifts, lambda t: t, rhs, 400, 1e-12)
    for i in range(3):
        rest = matrix @ x[:, i] - shifts[i] * x[:, i] - rhs[:, i]
        assert np.linalg.norm(rest) < 1e-8 * np.linalg.norm(rhs[:, i])


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(i % 2) * 1e12]) for i in range(4)]
    assert {r["deviation"] for r in run(frame(spark, rows, "double"))} == {None}


@pytest.mark.parametrize("k", [1, 3])
def test_fewer_components(spark, k):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((50, 6)).round(3))]
    compare(run(frame(spark, rows, "double"), k), [r[1] for r in rows], range(50), k)
