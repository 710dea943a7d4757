"""Wide vectors and networks beyond one task: decompositions, sketches, blocked layers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewlens.operators import decompose, generate


def frame(spark, x, labels=None, parts=6):
    labels = np.zeros(len(x), int) if labels is None else labels
    rows = [(i, int(c), [float(t) for t in v]) for i, (c, v) in enumerate(zip(labels, x))]
    return spark.createDataFrame(rows, "id long, c int, v array<double>").repartition(parts)


@pytest.mark.parametrize("decay", [0.5, 0.97, 1.0])
def test_singular_values(spark, decay):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 150)) * decay ** np.arange(150) + 7
    found = decompose.principal(frame(spark, x), "v", 6)
    _, want, right = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.abs(found.singular / want[:6] - 1).max() < 1e-6
    assert np.allclose(found.directions.T @ found.directions, np.eye(6), atol=1e-12)
    if decay < 1:
        assert np.abs(np.abs(np.sum(found.directions * right[:6].T, axis=0)) - 1).max() < 1e-6


def test_five_thousand_elements(spark):
    rng = np.random.default_rng(2)
    low = rng.standard_normal((120, 12)) * 0.7 ** np.arange(12)
    x = low @ rng.standard_normal((12, 5000)) + 1e-3 * rng.standard_normal((120, 5000))
    found = decompose.principal(frame(spark, x, parts=4), "v", 5)
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.abs(found.singular / want[:5] - 1).max() < 1e-6


def test_small_values_keep_their_accuracy(spark):
    """A triangle of the rows, not of their squares: values eleven orders apart."""
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((300, 4)))[0]
    x = q * np.array([1e3, 1.0, 1e-4, 1e-8])
    r = decompose.triangle(frame(spark, x), "v", np.zeros(4), np.eye(4))
    assert np.abs(np.linalg.svd(r, compute_uv=False) / [1e3, 1.0, 1e-4, 1e-8] - 1).max() < 1e-3


def test_directions_of_few_rows(spark):
    x = np.array([[1.0, 2.0, 3.0], [2.0, 0.0, 1.0]])
    found = decompose.principal(frame(spark, x), "v", 2)
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert found.singular[0] == pytest.approx(want[0]) and found.singular[1] < 1e-12
    none = decompose.principal(frame(spark, x).limit(0), "v", 2)
    assert none.directions.shape == (0, 0)


def moments_of(model):
    out = {}
    for r in model.collect():
        d = len(r["mean"])
        w = np.array(r["factors"]).reshape(d, -1)
        out[r["c"]] = (r["n"], np.array(r["mean"]), w @ w.T + np.diag(np.array(r["sigma"]) ** 2))
    return out


def test_sketch_equals_covariance_where_it_holds_all(spark):
    rng = np.random.default_rng(4)
    labels = np.arange(900) % 3
    x = rng.standard_normal((900, 64)) @ rng.standard_normal((64, 64)) + labels[:, None] * 100
    df = frame(spark, x, labels)
    exact = moments_of(generate.fit_latent(df, "c", "v", k=6))
    sketched = moments_of(generate.fit_latent(df, "c", "v", k=6, max_dim=32, sketch_rows=64))
    for c, (n, mean, cov) in exact.items():
        assert sketched[c][0] == n
        assert np.allclose(sketched[c][1], mean, rtol=1e-10)
        assert np.allclose(sketched[c][2], cov, rtol=1e-6, atol=1e-6 * np.abs(cov).max())


def test_sketch_within_its_bound(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1200, 64)) * 0.8 ** np.arange(64)
    row = generate.class_sketches(frame(spark, x), "c", "v", 24).head()
    b = np.array(row["sketch"]).reshape(-1, 64)
    y = x - x.mean(axis=0)
    off = np.linalg.norm(y.T @ y - b.T @ b, 2)
    values = np.linalg.svd(y, compute_uv=False) ** 2
    # by merges in two levels; the bound of frequent directions for the best k below the size
    assert off <= min(values[k:].sum() / (24 - k) for k in range(24)) * (1 + 1e-9)
    assert np.allclose(row["squares"], (y * y).sum(axis=0)) and len(b) <= 24


def test_ten_thousand_elements(spark):
    rng = np.random.default_rng(6)
    labels = np.arange(80) % 2
    base = rng.standard_normal((2, 10_000))
    x = rng.standard_normal((80, 2)) @ base + labels[:, None] * 3.0
    df = frame(spark, x, labels, parts=4)
    model = generate.fit_latent(df, "c", "v", k=2, shrinkage=1.0)
    drawn = generate.sample_latent(model, "c", 300)
    rows = np.array([r["features"] for r in drawn.where("c = 1").collect()])
    assert rows.shape == (300, 10_000)
    assert np.abs(rows.mean() - 3.0) < 0.5
    # all variance lies in the two directions
    centred = rows - rows.mean(axis=0)
    q = np.linalg.qr(base.T)[0]
    assert np.linalg.norm(centred @ q) > 0.99 * np.linalg.norm(centred)


def network(spark, rng, shapes):
    rows = []
    for layer, (width, units, activation, with_label) in enumerate(shapes):
        w = rng.standard_normal((units, width + (3 if with_label else 0))) / np.sqrt(width)
        rows += [(layer, activation, with_label, u, float(rng.normal()), [float(t) for t in w[u]]) for u in range(units)]
    return spark.createDataFrame(rows, generate.WEIGHTS_SCHEMA)


@pytest.mark.parametrize("limit", [400, 1500, 3000, 8000])
def test_network_cut_into_blocks(spark, limit):
    rng = np.random.default_rng(7)
    weights = network(spark, rng, [(8, 20, "leaky_relu", True), (20, 17, "relu", False), (17, 5, "sigmoid", True)])
    df = frame(spark, rng.standard_normal((40, 8)), np.arange(40) % 3)
    whole = {r["id"]: r for r in generate.mlp_forward(df, "v", "c", 3, weights).collect()}
    cut = generate.mlp_forward(df, "v", "c", 3, weights, weight_bytes=limit)
    assert cut.columns == ["id", "c", "v", "features"]
    for r in cut.collect():
        assert np.abs(np.array(r["features"]) - whole[r["id"]]["features"]).max() < 1e-9
        assert len(r["features"]) == 5 and r["v"] == whole[r["id"]]["v"]
