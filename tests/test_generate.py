import numpy as np
import pytest
from pyspark.sql import functions as F

from skewlens.functions import vectors as v
from skewlens.functions.hashing import hash_uniform
from skewlens.operators import generate, scoring


def gaussian(spark, n=600, dim=6, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = 0 if i % 10 else 1
        base = rng.normal(size=2)
        x = np.concatenate([base * 2, base + rng.normal(size=2) * 0.3, rng.normal(size=dim - 4)]) + 5 * c
        rows.append((i, c, [float(t) for t in x]))
    return spark.createDataFrame(rows, "id long, c int, v array<double>")


def arrays(df):
    out = {}
    for r in df.select("c", "v").collect():
        out.setdefault(r["c"], []).append(r["v"])
    return {c: np.array(x) for c, x in out.items()}


def test_covariances_match_numpy(spark):
    df = gaussian(spark)
    data = arrays(df)
    for r in generate.class_covariances(df.repartition(5), "c", "v").collect():
        x = data[r["c"]]
        assert r["n"] == len(x)
        assert np.allclose(r["mean"], x.mean(axis=0))
        d = x.shape[1]
        assert np.allclose(np.array(r["scatter"]).reshape(d, d) / len(x), np.cov(x.T, bias=True))


def test_many_classes_are_released_in_parts(spark, monkeypatch):
    monkeypatch.setattr(generate, "HELD_BYTES", 500)
    rows = [(i % 200, [float(i), 1.0]) for i in range(1000)]
    df = spark.createDataFrame(rows, "c int, v array<double>").coalesce(1)
    got = {r["c"]: (r["n"], r["mean"][0]) for r in generate.class_covariances(df, "c", "v").collect()}
    assert len(got) == 200 and got[3] == (5, 403.0)


def test_latent_model_reproduces_class_moments(spark):
    df = gaussian(spark)
    model = generate.fit_latent(df, "c", "v", k=6, shrinkage=0.0)
    drawn = generate.sample_latent(model, "c", 20_000, out="v")
    real, fake = arrays(df), arrays(drawn)
    for c in real:
        assert len(fake[c]) == 20_000
        assert np.allclose(real[c].mean(axis=0), fake[c].mean(axis=0), atol=0.1)
        assert np.allclose(np.cov(real[c].T, bias=True), np.cov(fake[c].T, bias=True), atol=0.2)


def test_samples_do_not_depend_on_partitioning(spark):
    model = generate.fit_latent(gaussian(spark), "c", "v", k=2)
    counts = spark.createDataFrame([(0, 5000), (1, 3)], "c int, n_samples long")
    a = {(r["c"], r["sample_id"]): r["features"] for r in generate.sample_latent(model, "c", counts).collect()}
    b = {
        (r["c"], r["sample_id"]): r["features"]
        for r in generate.sample_latent(model.repartition(3), "c", counts).collect()
    }
    assert a.keys() == b.keys() and len(a) == 5003
    assert all(np.allclose(a[key], b[key]) for key in list(a)[::97])


def test_class_smaller_than_dimension_borrows_shape(spark):
    df = gaussian(spark).where("c = 0 or id < 30")
    r = {row["c"]: row for row in generate.fit_latent(df, "c", "v", k=2, shrinkage=50.0).collect()}
    assert r[1]["n"] == 3 and all(s > 0 for s in r[1]["sigma"])


def test_mlp_matches_numpy(spark):
    rng = np.random.default_rng(0)
    w1, w2 = rng.normal(size=(5, 7)), rng.normal(size=(3, 8))
    rows = [(0, "leaky_relu", True, u, 0.1 * u, [float(t) for t in w1[u]]) for u in range(5)]
    rows += [(1, "sigmoid", True, u, -0.2, [float(t) for t in w2[u]]) for u in range(3)]
    weights = spark.createDataFrame(rows, generate.WEIGHTS_SCHEMA)
    z = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(i, i % 3, [float(t) for t in z[i]]) for i in range(40)], "id int, c int, z array<double>")
    got = {r["id"]: r["y"] for r in generate.mlp_forward(df, "z", "c", 3, weights, "y").collect()}
    for i in range(40):
        one = np.eye(3)[i % 3]
        h = np.concatenate([z[i], one]) @ w1.T + 0.1 * np.arange(5)
        h = np.concatenate([np.where(h > 0, h, 0.2 * h), one]) @ w2.T - 0.2
        assert np.allclose(got[i], 1 / (1 + np.exp(-h)))


def test_grid_and_noise(spark):
    classes = spark.createDataFrame([(0, "a"), (1, "b")], "label_idx int, name string")
    grid = generate.grid(classes, 500)
    assert grid.groupBy("name").count().where("count = 500").count() == 2
    noisy = generate.with_noise(grid, 8, ["label_idx", "sample_id"])
    z = np.array([r["z"] for r in noisy.collect()])
    assert z.shape == (1000, 8)
    assert abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05
    assert abs(np.corrcoef(z.T) - np.eye(8)).max() < 0.15


def test_pairs(spark):
    real = spark.range(50).select("id", F.array(F.lit(1.0)).alias("v"))
    fake = spark.range(50).select("id", F.array(F.lit(0.0)).alias("v"))
    rows = generate.pair_interpolate(real, fake, "id", "id", "v").collect()
    assert len({r["real_id"] for r in rows}) == 50 == len({r["fake_id"] for r in rows})
    assert all(r["v"][0] == pytest.approx(r["alpha"]) for r in rows)


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, -2.0], [3.0, 0.0], 1)], "a array<double>, b array<double>, c int")
    row = df.select(
        v.one_hot("c", 3).alias("hot"), v.condition("a", "c", 2).alias("cond"), v.lerp("a", "b", F.lit(0.5)).alias("mid"),
        v.relu("a").alias("relu"), v.leaky_relu("a").alias("leaky"), v.l2_norm("b").alias("norm"),
        v.unit_norm_penalty("b").alias("pen"), v.squared_error("a", "b").alias("se"),
    ).head()
    assert row["hot"] == [0.0, 1.0, 0.0] and row["cond"] == [1.0, -2.0, 0.0, 1.0]
    assert row["mid"] == [2.0, -1.0] and row["relu"] == [1.0, 0.0] and row["leaky"] == [1.0, -0.4]
    assert (row["norm"], row["pen"], row["se"]) == (3.0, 4.0, 8.0)


def test_full_rank_code_is_lossless(spark):
    df = gaussian(spark, n=200)
    full = scoring.reconstruct(df, "v", 6, ["id"])
    assert full.agg(F.max("sq_error")).head()[0] < 1e-18
    errors = [scoring.reconstruct(df, "v", k, ["id"]).agg(F.sum("sq_error")).head()[0] for k in (1, 3)]
    x = np.array([r["v"] for r in df.collect()])
    singular = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert errors == pytest.approx([singular[1:].sum(), singular[3:].sum()])


def test_separable_classes_are_recognised(spark):
    df = gaussian(spark)
    coded = scoring.reconstruct(df, "v", 3, ["id", "c"])
    rows = {(r["split"], r["c"]): r for r in scoring.latent_separability(coded, ["id"], "c", "v").collect()}
    assert all(r["accuracy"] > 0.9 for r in rows.values()) and len(rows) == 4
    for r in rows.values():
        assert r["total_loss"] == pytest.approx(r["recon_loss"] + 0.1 * r["class_loss"])


def test_two_sample(spark):
    df = gaussian(spark)
    far = df.withColumn("v", F.transform("v", lambda x: x + 4.0))
    scores = scoring.two_sample_scores(df, far, ["id"], ["id"], "c", "v", 2)
    told = {(r["split"], r["c"]): r for r in scoring.two_sample_summary(scores, ["split", "c"]).collect()}
    assert all(r["auc"] > 0.98 and r["p_real_on_real"] > r["p_real_on_generated"] for r in told.values())
    assert sum(r["n"] for r in told.values()) == 2 * df.count()
    scores = scoring.two_sample_scores(df, df, ["id"], ["id"], "c", "v", 2)
    same = scoring.two_sample_summary(scores, ["split"]).collect()
    assert all(abs(r["auc"] - 0.5) < 0.12 for r in same)


def test_auc_counts_ties_as_half(spark):
    rows = [(0, 1, 0.9), (0, 1, 0.5), (0, 0, 0.5), (0, 0, 0.1)]
    df = spark.createDataFrame(rows, "c int, target int, p_real double")
    assert scoring.two_sample_summary(df, ["c"]).head()["auc"] == pytest.approx(3.5 / 4)


def test_auc_is_exact(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.random(500), rng.random(20) * 1e-9, [0.0, 1.0, 1.0]])
    t = rng.integers(0, 2, len(p))
    df = spark.createDataFrame([(0, int(a), float(b)) for a, b in zip(t, p)], "c int, target int, p_real double")
    won = sum((a > b) + (a == b) / 2 for a in p[t == 1] for b in p[t == 0])
    assert scoring.two_sample_summary(df, ["c"]).head()["auc"] == pytest.approx(won / (t.sum() * (1 - t).sum()), abs=1e-12)


def test_covariance_far_from_zero(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    rows = [(int(i % 2), [float(v) for v in x[i] + [1e8, -3e8 * (i % 2)]]) for i in range(400)]
    got = generate.class_covariances(spark.createDataFrame(rows, "c int, v array<double>").repartition(7), "c", "v")
    for r in got.collect():
        assert np.allclose(np.array(r["scatter"]).reshape(2, 2) / r["n"], np.cov(x[r["c"] :: 2].T, bias=True), atol=1e-5)


def test_draws_reach_every_row_of_a_large_class(spark):
    at = [r[0] for r in spark.range(2000).select(F.floor(hash_uniform(1, "t", "id") * F.lit(10.0**12)).cast("long")).collect()]
    assert {a % 2 for a in at} == {0, 1} and len({a % 256 for a in at}) > 250


def test_forest(spark):
    df = gaussian(spark)
    scored = scoring.forest_evaluate(df, df, "c", "v", ["id"], trees=10, depth=5)
    assert scored.where(F.col("true") == F.col("pred")).count() > 590
