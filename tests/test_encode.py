import pytest
from pyspark.sql import functions as F

from skewlens.operators import encode


def test_scaler_uses_population_std_and_skips_constants(spark):
    train = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    test = spark.createDataFrame([(3.0, 7.0)], "a double, b double")
    params = encode.fit_scaler(train, ["a", "b"])
    got = sorted(r["a"] for r in encode.apply_scaler(train, params).collect())
    assert got == pytest.approx([-1.069045, -0.267261, 1.336306], abs=1e-6)
    row = encode.apply_scaler(test, params).head()
    assert (row["a"], row["b"]) == (pytest.approx(0.534522, abs=1e-6), 2.0)
    back = encode.invert_scaler(encode.apply_scaler(test, params, "_z"), params, "_z").head()
    assert (back["a"], back["b"]) == (pytest.approx(3.0), 7.0)


def test_onehot_keeps_training_vocabulary(spark):
    train = spark.createDataFrame([("a", "y"), ("b", "x"), ("c", "x")], "p string, q string")
    test = spark.createDataFrame([("a", "x"), ("z", "y"), (None, "w")], "p string, q string")
    vocab = encode.fit_onehot(train, ["p", "q"])
    order = [(r["feature"], r["value"]) for r in vocab.orderBy("position").collect()]
    assert order == [("p", "a"), ("p", "b"), ("p", "c"), ("q", "x"), ("q", "y")]
    rows = [r["onehot"] for r in encode.apply_onehot(test, vocab).collect()]
    assert sorted(rows) == [[0.0] * 5, [0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 1.0, 0.0]]


def test_label_codes_and_unseen(spark):
    df = spark.createDataFrame([("R2L",), ("DoS",), ("Normal",), ("U2R",), ("Probe",)], "c string")
    dim = encode.fit_labels(df, "c")
    assert {r["c"]: r["label_idx"] for r in dim.collect()} == {"DoS": 0, "Normal": 1, "Probe": 2, "R2L": 3, "U2R": 4}
    unseen = spark.createDataFrame([("DoS",), ("new",), (None,)], "c string")
    with pytest.raises(Exception, match="label without a code"):
        encode.apply_labels(unseen, dim, "c").collect()
    codes = encode.apply_labels(unseen, dim, "c", on_unseen="null").collect()
    assert sorted(str(r["label_idx"]) for r in codes) == ["0", "None", "None"]
    assert encode.decode_labels(encode.apply_labels(df, dim, "c").drop("c"), dim, "c").count() == 5


def test_assembled_order_matches_names(spark):
    df = spark.createDataFrame([(1.0, "t"), (3.0, "u")], "x double, p string")
    params, vocab = encode.fit_scaler(df, ["x"]), encode.fit_onehot(df, ["p"])
    rows = {r["p"]: r["features"] for r in encode.assemble(df, params, vocab).collect()}
    assert rows == {"t": [-1.0, 1.0, 0.0], "u": [1.0, 0.0, 1.0]}
    names = [r["name"] for r in encode.feature_names(params, vocab).orderBy("position").collect()]
    assert names == ["x", "p_t", "p_u"]


def test_transforms_need_no_shuffle(spark, data):
    items = spark.read.parquet(f"{data}/lineitem.parquet")
    params = encode.fit_scaler(items, ["l_quantity", "l_tax"])
    vocab = encode.fit_onehot(items, ["l_returnflag"])
    plan = encode.assemble(items, params, vocab).select("features")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "l_quantity" in plan and "l_extendedprice" not in plan
    assert items.where(F.col("l_quantity").isNull()).count() == 0


def test_wide_vocabulary(spark):
    """Wider than the dense form allows: an argument, or the sparse form."""
    rows = spark.range(20_001).select(F.format_string("v%06d", "id").alias("k"), F.lit("x").alias("c"))
    vocab = encode.fit_onehot(rows, ["k", "c"])
    assert vocab.count() == 20_002
    sparse = encode.apply_onehot_sparse(rows, vocab, ["k", "c"]).where("k IN ('v000000', 'v020000')").orderBy("k").collect()
    assert [r["onehot"] for r in sparse] == [[0, 20_001], [20_000, 20_001]]
    unseen = spark.createDataFrame([("nope", None)], "k string, c string")
    assert encode.apply_onehot_sparse(unseen, vocab, ["k", "c"]).head()["onehot"] == []
    with pytest.raises(ValueError):
        encode.apply_onehot(rows, vocab)


def test_scaler_leaves_out_nan(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    row = encode.fit_scaler(df, ["x"]).head()
    assert (row["mean"], row["scale"]) == (2.0, 1.0)


def test_label_codes_have_no_window_over_all_labels(spark):
    dim = encode.fit_labels(spark.range(5000).select(F.col("id").cast("string").alias("l")), "l")
    assert [r["l"] for r in dim.orderBy("label_idx").collect()] == sorted(str(k) for k in range(5000))
