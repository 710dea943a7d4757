import math

import pytest
from pyspark.sql import functions as F

from skewlens.functions.hashing import hash_hex
from skewlens.operators import ordering, profile, sampling
from skewlens.operators.sampling import stratified_split
from skewlens.operators.ordering import expand_counts, first_batches, first_in_order, hash_ordinals, minibatches


def digests(n, tag):
    import hashlib

    return {i: hashlib.md5(f"42:{tag}:{i}".encode()).hexdigest() for i in range(n)}


def test_published_quotas(spark):
    counts = spark.createDataFrame(
        [("DoS", 45927), ("Normal", 67343), ("Probe", 11656), ("R2L", 995), ("U2R", 52)], "c string, n long"
    )
    got = {r["c"]: r["quota"] for r in sampling.split_quotas(counts, "c").collect()}
    assert got == {"DoS": 36741, "Normal": 53874, "Probe": 9325, "R2L": 796, "U2R": 42}
    assert sum(got.values()) == 100778


def skewed(spark, n=6000):
    cls = F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") % 7 == 0, None).otherwise("big")
    return spark.range(n).withColumn("c", cls)


@pytest.mark.parametrize("bucket_rows", [8192, 2])
def test_split_is_exact_and_independent_of_partitioning(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", bucket_rows)
    df = skewed(spark)
    first = sampling.stratified_split(df, ["id"], "c").collect()
    again = sampling.stratified_split(df.repartition(13), ["id"], "c").collect()
    assert {r["id"]: r["split"] for r in first} == {r["id"]: r["split"] for r in again}
    assert len(first) == 6000
    counts = {}
    for r in first:
        counts.setdefault(r["c"], [0, 0])[r["split"] == "val"] += 1
    quotas = {r["c"]: r["quota"] for r in sampling.split_quotas(df.groupBy("c").agg(F.count("*").alias("n")), "c").collect()}
    assert {c: v[0] for c, v in counts.items()} == quotas
    assert sum(v[1] for v in counts.values()) == 1200
    h = digests(6000, "split")
    for c in quotas:
        train = [h[r["id"]] for r in first if r["c"] == c and r["split"] == "train"]
        val = [h[r["id"]] for r in first if r["c"] == c and r["split"] == "val"]
        assert max(train) < min(val)


def test_split_single_class_and_empty(spark):
    df = spark.range(10).withColumn("c", F.lit(1))
    rows = sampling.stratified_split(df, ["id"], "c").collect()
    assert sum(r["split"] == "train" for r in rows) == 8
    assert sampling.stratified_split(df.where("id < 0"), ["id"], "c").collect() == []


@pytest.mark.parametrize("bucket_rows", [8192, 2, 0.5, 0.001])
def test_ordinals_are_hash_ranks(spark, monkeypatch, bucket_rows):
    """Also with bucket limits that call for four to seven prefix digits, so that offsets
    add up over one, two and three levels."""
    monkeypatch.setattr(ordering, "BUCKET_ROWS", bucket_rows)
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    got = {r["id"]: r["pos"] for r in hash_ordinals(df, ["id"], tag="t").collect()}
    h = digests(5000, "t")
    assert got == {i: p for p, i in enumerate(sorted(range(5000), key=h.get))}
    grouped = hash_ordinals(df, ["id"], tag="t", group=["g"]).collect()
    for g in range(3):
        ids = sorted((i for i in range(5000) if i % 3 == g), key=h.get)
        assert {r["id"]: r["pos"] for r in grouped if r["g"] == g} == {i: p for p, i in enumerate(ids)}


@pytest.mark.parametrize("bucket_rows", [8192, 1])
def test_ordinals_of_null_groups(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", bucket_rows)
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    rows = hash_ordinals(df, ["id"], tag="t", group=["g"]).collect()
    h = digests(3000, "t")
    for g in (None, 1, 2):
        ids = sorted((i for i in range(3000) if (i % 3 or None) == g), key=h.get)
        assert {r["id"]: r["pos"] for r in rows if r["g"] == g} == {i: p for p, i in enumerate(ids)}


def test_ordinals_shuffle_the_rows_once(spark, monkeypatch):
    """Even when the offsets are too large to be sent to every task."""
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(3000).withColumn("g", F.col("id") % 3)
        plan = hash_ordinals(df, ["id"], group=["g"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    rows_side = plan[plan.index("SortMergeJoin"):]
    rows_side = rows_side[: rows_side.index("Range (")]
    assert rows_side.count("Exchange") == 1
    assert rows_side.index("Window") < rows_side.index("Exchange")


def test_repeated_keys_keep_every_quota(spark, monkeypatch):
    for limit in (2, 8192):
        monkeypatch.setattr(ordering, "BUCKET_ROWS", limit)
        df = spark.range(10).select(F.lit(1).alias("k"))
        assert first_in_order(df, ["k"], 5).count() == 5
        rows = spark.range(80).select(F.when(F.col("id") < 50, 1).otherwise(2).alias("k"), F.lit("a").alias("c"))
        split = {r["split"]: r["count"] for r in stratified_split(rows, ["k"], "c").groupBy("split").count().collect()}
        assert split == {"train": 64, "val": 16}
        mixed = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("c"), "id")
        out = stratified_split(mixed, ["k"], "c").cache()
        assert out.count() == 1000 and out.select("id").distinct().count() == 1000
        assert out.where("split = 'val'").count() == 200
        per = {r["c"]: r["count"] for r in out.where("split = 'train'").groupBy("c").count().collect()}
        assert sorted(per.values()) == [266, 267, 267]


def test_minibatches(spark):
    rows = minibatches(spark.range(1000), ["id"]).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in rows] == [256, 256, 256, 232]
    epochs = [
        {r["id"]: r["batch_id"] for r in minibatches(spark.range(1000), ["id"], epoch=e).collect()} for e in (0, 1)
    ]
    assert epochs[0] != epochs[1]


def test_first_batches_include_the_stop_index(spark):
    taken = first_batches(spark.range(1000), ["id"], stop_after=2)
    assert taken.count() == 768
    batches = minibatches(spark.range(1000), ["id"]).where("batch_id <= 2")
    assert {r["id"] for r in taken.collect()} == {r["id"] for r in batches.collect()}
    assert first_batches(spark.range(1000), ["id"], stop_after=50).count() == 1000


def test_uniform_labels_and_chi_square(spark):
    drawn = sampling.uniform_labels(spark.range(25_600), ["id"], 5)
    dim = spark.range(5).select(F.col("id").cast("int").alias("label_idx"))
    row = sampling.chi_square_uniform(profile.class_counts(drawn, "label_idx", dim)).head()
    assert row["n_rows"] == 25_600 and row["is_uniform"]
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([10, 20, 30, 40, 0])], "c int, n long")
    row = sampling.chi_square_uniform(counts).head()
    assert row["chi_square"] == pytest.approx(50.0) and not row["is_uniform"] and row["dof"] == 4


def test_expand_counts_over_chunks(spark):
    df = spark.createDataFrame([("a", 25), ("b", 0), ("c", 10), ("d", 1)], "c string, n long")
    rows = expand_counts(df, "n", "i", chunk=10).groupBy("c").agg(F.sort_array(F.collect_list("i")).alias("i")).collect()
    assert {r["c"]: r["i"] for r in rows} == {"a": list(range(25)), "c": list(range(10)), "d": [0]}


@pytest.mark.parametrize("per_row", [1000, 3])
def test_weighted_resample_balances_classes(spark, monkeypatch, per_row):
    """A one-row class supplies its whole share, with and without salted copies."""
    monkeypatch.setattr(sampling, "DRAWS_PER_ROW", per_row)
    df = spark.range(1001).withColumn("c", F.when(F.col("id") == 1000, "one").otherwise("many"))
    rows = sampling.weighted_resample(df, ["id"], "c", 4000).collect()
    assert sorted(r["draw_id"] for r in rows) == list(range(4000))
    ones = [r for r in rows if r["c"] == "one"]
    assert {r["id"] for r in ones} == {1000}
    assert abs(len(ones) - 2000) < 5 * math.sqrt(1000)
    assert all(r["id"] < 1000 for r in rows if r["c"] == "many")


def test_weighted_resample_with_given_weights(spark):
    df = spark.range(400).withColumn("c", (F.col("id") % 2).cast("int"))
    weights = spark.createDataFrame([(0, 3.0), (1, 1.0)], "c int, weight double")
    rows = sampling.weighted_resample(df, ["id"], "c", 4000, weights).groupBy("c").count().collect()
    got = {r["c"]: r["count"] for r in rows}
    assert abs(got[0] - 3000) < 5 * math.sqrt(750)


def test_weighted_resample_over_many_classes(spark):
    """More classes than slots of the interval lookup, one of them empty of weight."""
    df = spark.range(6000).withColumn("c", (F.col("id") % 5000).cast("int"))
    weights = spark.range(5000).select(
        F.col("id").cast("int").alias("c"), F.when(F.col("id") == 7, 0.0).otherwise(1.0).alias("weight")
    )
    rows = sampling.weighted_resample(df, ["id"], "c", 20_000, weights).collect()
    assert sorted(r["draw_id"] for r in rows) == list(range(20_000))
    assert all(r["id"] % 5000 == r["c"] != 7 for r in rows)
    assert len({r["id"] for r in rows}) > 5500


def test_hash_is_stable(spark):
    row = spark.range(1).select(hash_hex(42, "split", "id").alias("h")).head()
    assert row["h"] == digests(1, "split")[0]
