"""Approximate neighbours against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewlens.operators import approximate
from skewlens.operators.neighbors import knn


def clustered(spark, n=4000, d=12, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, d)) * 5
    x = centres[rng.integers(0, 40, n)] + rng.standard_normal((n, d))
    rows = [(i, "big" if i % 8 else "small", [float(t) for t in v]) for i, v in enumerate(x)]
    rows += [(n + i, "big", rows[1][2]) for i in range(copies)]
    return spark.createDataFrame(rows, "id long, c string, v array<double>")


def recall(exact, found):
    both = exact.select("id", "neighbor_id").intersect(found.select("id", "neighbor_id")).count()
    return both / exact.count()


@pytest.mark.parametrize("wanted", [0.8, 0.95])
def test_recall(spark, wanted):
    df = clustered(spark)
    some = df.where("id % 10 = 0").select("c", "id")
    exact = knn(df, "id", "c", "v", k=5, queries=some)
    found = knn(df, "id", "c", "v", k=5, queries=some, recall=wanted, bucket_rows=128)
    assert recall(exact, found) >= wanted - 0.05
    assert found.groupBy("id").count().where("count <> 5").count() == 0
    # distances are exact, and small classes are searched whole
    same = exact.join(found.withColumnRenamed("distance", "d"), ["c", "id", "neighbor_id"]).where(F.abs(F.col("d") - F.col("distance")) > 1e-12)
    assert same.count() == 0
    small = "c = 'small' and id < 0"
    assert exact.where(small).exceptAll(found.where(small)).count() == 0


def test_fewer_probes_where_less_recall_is_asked(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 16))
    queries, near = x[:300], x[:300] + 0.1 * rng.standard_normal((300, 16))
    low, high = approximate.Cuts(x, 6, 1), approximate.Cuts(x, 6, 1)
    low.choose(queries, near, 0.6)
    assert high.choose(queries, near, 0.99) >= 0.99
    assert low.tables * low.probes < high.tables * high.probes < 64
    # every bucket probed at most once, the own one first by distance
    codes = high.probed(queries, 0)
    assert all(len(set(row)) == high.probes for row in codes.tolist())
    assert all(c in row for c, row in zip(high.codes(queries, 0).tolist(), codes.tolist()))


def test_copies_are_neighbours(spark):
    df = clustered(spark, n=1600, copies=900)
    some = df.where("id >= 1600 and id % 50 = 0").select("c", "id")
    found = knn(df, "id", "c", "v", k=3, queries=some, recall=0.9, bucket_rows=64)
    assert found.count() == 3 * some.count() and found.agg(F.max("distance")).head()[0] == 0.0


def test_empty(spark):
    df = clustered(spark, n=10)
    assert knn(df.limit(0), "id", "c", "v", recall=0.9).count() == 0
    assert knn(df, "id", "c", "v", k=2, recall=0.9).count() == knn(df, "id", "c", "v", k=2).count()
