import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skewlens.operators import profile
from skewlens.sources.schema import CATEGORY_OF, label_dim, record_schema

# Published label counts of the training records and category totals.
TRAIN_LABELS = {
    "normal": 67343, "neptune": 41214, "satan": 3633, "ipsweep": 3599, "portsweep": 2931, "smurf": 2646,
    "nmap": 1493, "back": 956, "teardrop": 892, "warezclient": 890, "pod": 201, "guess_passwd": 53,
    "buffer_overflow": 30, "warezmaster": 20, "land": 18, "imap": 11, "rootkit": 10, "loadmodule": 9,
    "ftp_write": 8, "multihop": 7, "phf": 4, "perl": 3, "spy": 2,
}
TRAIN_CATEGORIES = {
    "Normal": (67343, 53.46), "DoS": (45927, 36.46), "Probe": (11656, 9.25), "R2L": (995, 0.79), "U2R": (52, 0.04),
}
TEST_CATEGORIES = {
    "Normal": (9711, 43.08), "DoS": (7458, 33.08), "R2L": (2754, 12.22), "Probe": (2421, 10.74), "U2R": (200, 0.89),
}


def many(spark, counts, name):
    rows = spark.createDataFrame(list(counts.items()), f"{name} string, n long")
    # sequence(1, 0) would count down, so empty classes are left out first
    return rows.where("n > 0").select(name, F.explode(F.expr("sequence(1L, n)"))).select(name)


def test_record_layout():
    assert len(record_schema()) == 43
    mapping = CATEGORY_OF
    assert len(mapping) == 40
    sizes = pd.Series(mapping).value_counts().to_dict()
    assert sizes == {"R2L": 15, "DoS": 10, "U2R": 8, "Probe": 6, "Normal": 1}


def test_labels_roll_up_to_categories(spark):
    mapped = profile.map_category(many(spark, TRAIN_LABELS, "label"), "label", label_dim(spark))
    got = {r["category"]: (r["n"], r["pct"]) for r in profile.class_distribution(mapped, "category").collect()}
    assert got == TRAIN_CATEGORIES
    ratio = profile.imbalance_ratio(mapped, "category").head()
    assert (ratio["n_max"], ratio["n_min"]) == (67343, 52)
    assert profile.unmapped(mapped, "label", label_dim(spark)).count() == 0


def test_side_by_side_distribution(spark):
    train = many(spark, {k: v[0] for k, v in TRAIN_CATEGORIES.items()}, "category")
    test = many(spark, {k: v[0] for k, v in TEST_CATEGORIES.items()} | {"Other": 0}, "category")
    rows = profile.compare_distributions(train, test, "category").collect()
    got = {r["category"]: (r["n_train"], r["pct_train"], r["n_test"], r["pct_test"]) for r in rows}
    assert got == {k: TRAIN_CATEGORIES[k] + TEST_CATEGORIES[k] for k in TRAIN_CATEGORIES}


def test_class_missing_on_one_side_counts_zero(spark):
    a = spark.createDataFrame([("x",), ("y",)], "c string")
    b = spark.createDataFrame([("x",)], "c string")
    rows = {r["c"]: r for r in profile.compare_distributions(a, b, "c").collect()}
    assert (rows["y"]["n_test"], rows["y"]["pct_test"]) == (0, 0.0)


def test_unmapped_label_is_null_and_reported(spark):
    df = spark.createDataFrame([("x",), ("q",), ("q",), (None,)], "label string")
    dim = spark.createDataFrame([("x", "X")], "label string, category string")
    assert profile.map_category(df, "label", dim).where("category is null").count() == 3
    assert [r[0] for r in profile.unmapped(df, "label", dim).collect()] == ["q"]
    literal = profile.map_category_literal(df, "label", {"x": "X"})
    assert sorted(str(r["category"]) for r in literal.collect()) == ["None", "None", "None", "X"]


def test_missing_counts_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    assert profile.missing_total(df).head()[0] == 3
    assert profile.missing_total(df.where("false")).head()[0] == 0


def test_describe_small(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 10.0)], "v double")
    r = profile.describe(df, ["v"]).head()
    assert (r["n"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]) == (5, 1.0, 2.0, 3.0, 4.0, 10.0)
    assert r["std"] == pytest.approx(3.535534, abs=1e-6)


@pytest.mark.parametrize("limit", [2_000_000, 40])
def test_describe_narrowed_brackets(spark, monkeypatch, limit):
    """Quantiles stay exact when brackets have to be narrowed, with heavy ties."""
    monkeypatch.setattr(profile, "BRACKET_ROWS", limit)
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(size=30_000), 3)
    b = np.where(rng.random(30_000) < 0.4, 7.0, rng.exponential(size=30_000) * 10)
    pdf = pd.DataFrame({"a": a, "b": b})
    pdf.loc[:99, "a"] = np.nan
    got = profile.describe(spark.createDataFrame(pdf), ["a", "b"]).toPandas().set_index("feature")
    want = pdf.describe()
    for c in ("a", "b"):
        assert got.loc[c, "n"] == want.loc["count", c]
        for mine, theirs in {"mean": "mean", "std": "std", "min": "min", "p25": "25%", "p50": "50%", "p75": "75%", "max": "max"}.items():
            assert got.loc[c, mine] == pytest.approx(want.loc[theirs, c], rel=1e-12, abs=1e-12)


def test_describe_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    rows = {r["feature"]: r for r in profile.describe(df, ["a", "b"]).collect()}
    assert rows["a"]["n"] == 0 and rows["a"]["p50"] is None
    assert rows["b"]["p50"] == 1.0 and rows["b"]["std"] is None


def test_top_values(spark):
    df = spark.createDataFrame([("tcp", 1), ("tcp", 2), ("udp", 2), ("icmp", 2), (None, 3)], "p string, q int")
    rows = profile.top_values(df, ["p", "q"], 2).orderBy("feature", "rank").collect()
    assert [(r["feature"], r["value"], r["n"], r["n_unique"]) for r in rows] == [
        ("p", "tcp", 2, 3), ("p", "icmp", 1, 3), ("q", "2", 3, 3), ("q", "1", 1, 3),
    ]


def test_histogram_edges(spark):
    up = [("a", [float(v)]) for v in range(21)]
    flat = [("b", [5.0])] * 3
    df = spark.createDataFrame(up + flat, "g string, v array<double>")
    rows = profile.histogram(df, "g", "v", 1).collect()
    a = {r["bin"]: r["n"] for r in rows if r["g"] == "a"}
    assert len(a) == 20 and a[19] == 2 and all(a[i] == 1 for i in range(19))
    b = {r["bin"]: r for r in rows if r["g"] == "b"}
    assert b[10]["n"] == 3 and b[0]["edge_lo"] == 4.5 and b[19]["edge_hi"] == 5.5
    assert sum(r["n"] for r in b.values()) == 3


def test_histogram_matches_numpy(spark):
    x = np.random.default_rng(1).normal(size=(4000, 2)).round(2)
    df = spark.createDataFrame([("g", [float(a), float(b)]) for a, b in x], "g string, v array<double>")
    rows = profile.histogram(df, "g", "v", 2).collect()
    for f in range(2):
        got = [r["n"] for r in sorted((r for r in rows if r["feature"] == f), key=lambda r: r["bin"])]
        assert got == np.histogram(x[:, f], bins=20)[0].tolist()


def test_class_stats_population_std(spark):
    df = spark.createDataFrame([("a", [1.0, 5.0]), ("a", [3.0, 5.0])], "g string, v array<double>")
    rows = {r["feature"]: r for r in profile.class_stats(df, "g", "v", 2).collect()}
    assert (rows[0]["mean"], rows[0]["std"], rows[1]["std"]) == (2.0, 1.0, 0.0)


def test_counts_with_absent_class(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "c int")
    dim = spark.createDataFrame([(0,), (1,), (2,)], "c int")
    rows = {r["c"]: (r["n"], r["pct"]) for r in profile.class_counts_percent(df, "c", dim).collect()}
    assert rows[1] == (0, 0.0) and rows[0][0] == 2
    assert rows[0][1] == pytest.approx(200 / 3)


def test_before_after(spark):
    before = spark.createDataFrame([("u",)] * 3 + [("d",)] * 4, "c string")
    after = spark.createDataFrame([("u",)] * 10 + [("d",)] * 4, "c string")
    rows = {r["c"]: r for r in profile.before_after(before, after, "c").collect()}
    assert rows["u"]["n_added"] == 7 and rows["d"]["n_added"] == 0
    assert rows["u"]["log10_after"] == 1.0
