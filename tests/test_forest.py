"""The forest as a table of nodes, against direct checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewlens.operators import forest, scoring
from skewlens.session import fresh_path
from skewlens.sources import bundle


def points(spark, n=600, classes=2, seed=3, dim=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=dim)
        x = x + 0.3 * np.sign(x)
        rows.append((i, int(x[0] > 0) + (classes > 2) * 2 * int(x[1] > 0), [float(t) for t in x]))
    return spark.createDataFrame(rows, "id long, c int, v array<double>")


def accuracy(scored):
    return scored.agg(F.avg((F.col("true") == F.col("pred")).cast("int"))).head()[0]


def depth_of(nodes, tree=0):
    rows = {r["node"]: r for r in nodes.where(F.col("tree") == tree).collect()}
    deepest, todo = 0, [("0", 0)]
    while todo:
        name, level = todo.pop()
        deepest = max(deepest, level)
        if rows[name]["left"] is not None:
            todo += [(rows[name]["left"], level + 1), (rows[name]["right"], level + 1)]
    return deepest


@pytest.mark.parametrize("classes", [2, 4])
def test_rule_is_learned(spark, classes):
    df = points(spark, classes=classes)
    fitted = forest.fit(df.where("id % 5 > 0"), "c", "v", trees=30)
    assert accuracy(forest.predict(fitted, df.where("id % 5 = 0"), "c", "v", ["id"])) > 0.97
    # a point outside a tree's sample may fall to another class there, not in most trees
    assert accuracy(forest.predict(fitted, df.where("id % 5 > 0"), "c", "v")) == 1.0


def test_upper_levels_and_refitted_leaves(spark):
    df = points(spark, n=1500, classes=4)
    small = 8 * 6 * 100  # a hundred points a task
    fitted = forest.fit(df, "c", "v", trees=4, local_bytes=small)
    assert fitted.nodes.where("node like '%/%/%'").count() > 0
    assert accuracy(forest.predict(fitted, df, "c", "v")) > 0.98
    leaves = fitted.nodes.where("feature < 0")
    assert leaves.where(F.size("classes") != 1).count() == 0  # grown to purity
    for tree in range(4):
        assert depth_of(fitted.nodes, tree) > 1


def test_leaf_that_needs_depth_forty(spark):
    """Every feature sets one group apart, so a tree has to take the groups off one by one."""
    d = 90
    rows = [(g, g % 2, [1.0 if j == g else 0.0 for j in range(d)]) for g in range(d) for _ in range(30)]
    df = spark.createDataFrame(rows, "id int, c int, v array<double>")
    fitted = forest.fit(df, "c", "v", trees=3)
    assert max(depth_of(fitted.nodes, t) for t in range(3)) >= 40
    assert accuracy(forest.predict(fitted, df, "c", "v")) == 1.0
    shallow = forest.fit(df, "c", "v", trees=3, depth=5)
    assert max(depth_of(shallow.nodes, t) for t in range(3)) == 5


def test_depth_limit_counts_upper_levels(spark):
    df = points(spark, n=1500, classes=4)
    fitted = forest.fit(df, "c", "v", trees=2, depth=4, local_bytes=8 * 6 * 200)
    assert max(depth_of(fitted.nodes, t) for t in range(2)) <= 4


def test_blocks_of_trees_give_the_same_votes(spark):
    df = points(spark, classes=4)
    fitted = forest.fit(df, "c", "v", trees=12, depth=3)
    whole = forest.predict(fitted, df, "c", "v", ["id"])
    cut = forest.predict(fitted, df, "c", "v", ["id"], forest_bytes=500)
    assert sorted(whole.collect()) == sorted(cut.collect())


def test_trees_that_score_are_views_of_arrays(spark):
    """What a task holds of a forest is what its bytes are counted as: no object a node."""
    import tracemalloc

    df = points(spark, n=3000).withColumn("c", F.pmod(F.xxhash64("id"), F.lit(5)).cast("int"))
    fitted = forest.fit(df, "c", "v", trees=6)
    n = fitted.nodes.count()
    table = forest._packed(fitted.nodes, False)
    assert n > 6000 and table.nbytes <= forest.NODE_BYTES * n
    tracemalloc.start()
    trees = forest._trees(table)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(trees) == list(range(6)) and used < 4 * n  # bytes; the views cost some thousand a tree


@pytest.mark.parametrize("local_bytes", [forest.LOCAL_BYTES, 8 * 6 * 100])
def test_scores_match_a_plain_walk(spark, local_bytes):
    """Also below upper levels: every row's votes, read node by node from the table."""
    df = points(spark, n=400, classes=4)
    fitted = forest.fit(df, "c", "v", trees=3, local_bytes=local_bytes)
    nodes = {(r["tree"], r["node"]): r for r in fitted.nodes.collect()}

    def vote(x):
        votes = [0.0] * 4
        for tree in range(3):
            at = nodes[tree, "0"]
            while at["feature"] >= 0:
                at = nodes[tree, at["left"] if x[at["feature"]] <= at["threshold"] else at["right"]]
            for c, share in zip(at["classes"], at["shares"]):
                votes[c] += share
        return votes.index(max(votes))

    got = {r["id"]: r["pred"] for r in forest.predict(fitted, df, "c", "v", ["id"]).collect()}
    assert got == {r["id"]: vote(r["v"]) for r in df.collect()}


def test_written_and_read_back(spark):
    df = points(spark)
    fitted = forest.fit(df, "c", "v", trees=5)
    path = fresh_path(spark, "saved-forest")
    fitted.write(path)
    again = forest.read_forest(spark, path)
    assert again.trees == 5
    same = [sorted(forest.predict(f, df, "c", "v", ["id"]).collect()) for f in (fitted, again)]
    assert same[0] == same[1]


def test_same_forest_whatever_the_partitions(spark):
    df = points(spark, n=300)
    key = lambda f: sorted(map(str, f.nodes.collect()))
    assert key(forest.fit(df.repartition(7), "c", "v", trees=3)) == key(forest.fit(df.coalesce(1), "c", "v", trees=3))


def test_copies_weigh_as_rows(spark):
    n = np.array([1, 5, 32, 33, 1000])
    found = np.array([forest.bootstrap(np.arange(5), n, t, 42) for t in range(4000)])
    assert np.abs(found.mean(axis=0) / n - 1).max() < 0.06
    assert np.abs(found.var(axis=0) / n - 1).max() < 0.12


def test_odd_rows(spark):
    df = spark.createDataFrame([(0, 1, [1.0]), (1, None, [2.0]), (2, 1, None), (3, 1, [1.0])], "id int, c int, v array<double>")
    rows = {r["id"]: r["pred"] for r in forest.predict(forest.fit(df, "c", "v", trees=3), df, "c", "v", ["id"]).collect()}
    assert rows == {0: 1, 1: 1, 2: None, 3: 1}
    none = forest.predict(forest.fit(df.limit(0), "c", "v", trees=3), df, "c", "v", ["id"])
    assert {r["pred"] for r in none.collect()} == {None}
    mixed = spark.createDataFrame([(i % 2, [1.0, 1.0]) for i in range(9)], "c int, v array<double>")
    assert forest.predict(forest.fit(mixed, "c", "v", trees=9), mixed, "c", "v").count() == 9


def test_models_after_a_bundle(spark):
    """Fits and scores with two and with ten classes do not change when a bundle is written
    or rows are observed in between."""
    from pyspark.sql import Observation

    df = points(spark, n=200)
    ten = df.withColumn("c", F.col("id").cast("int") % 10)

    def results():
        out = []
        for rows, k in ((df, 2), (ten, 10)):
            out.append(sorted(scoring.forest_evaluate(rows, rows, "c", "v", ["id"], trees=5).collect()))
            far = rows.withColumn("v", F.transform("v", lambda x: x + 3.0))
            scores = scoring.two_sample_scores(rows, far, ["id"], ["id"], "c", "v", k)
            out.append(sorted((tuple(r) for r in scoring.two_sample_summary(scores, ["split"]).collect())))
        return out

    before = results()
    classes = spark.createDataFrame([("a", 0)], "category string, label_idx int")
    bundle.write_bundle(df.withColumn("split", F.lit("train")).withColumnRenamed("v", "features"), fresh_path(spark, "b"), classes)
    df.observe(Observation(), F.count(F.lit(1))).count()
    after = results()
    assert before[0] == after[0] and before[2] == after[2]
    for a, b in ((before[1], after[1]), (before[3], after[3])):
        assert [x[0] for x in a] == [x[0] for x in b]
        assert np.allclose([x[2:] for x in a], [x[2:] for x in b], atol=1e-6)


def test_linear_models_are_parameters(spark):
    df = points(spark).select("c", F.col("v").alias("latent"), F.col("c").cast("double").alias("_label"))
    path = fresh_path(spark, "linear")
    for family, rows_of in (("binomial", 1), ("multinomial", 2)):
        fitted = scoring.fit_linear(df, "_label", "latent", family, 200)
        assert len(fitted.bias) == rows_of and fitted.settled
        fitted.table(spark).write.parquet(f"{path}-{family}")
        again = scoring.Linear.of_table(spark.read.parquet(f"{path}-{family}"))
        assert np.array_equal(again.weights, fitted.weights) and np.array_equal(again.bias, fitted.bias)
        row = df.select("latent", again.scores("latent").alias("s")).head()
        assert np.allclose(row["s"], fitted.weights @ row["latent"] + fitted.bias)
    assert not scoring.fit_linear(df, "_label", "latent", "binomial", 1).settled
