import numpy as np
import pytest
from pyspark.sql import functions as F

from skewlens.operators import history, metrics

# Published per-class accuracies (percent) and their macro averages.
PUBLISHED = [
    ([95, 100, 51, 3, 0], 49.8),
    ([83, 100, 48, 0, 0], 46.2),
    ([100, 100, 98, 0, 0], 59.6),
    ([100, 100, 0, 13, 0], 42.6),
    ([100, 100, 49, 0, 0], 49.8),
    ([100, 77, 9, 0, 0], 37.2),
    ([100, 100, 97, 0, 0], 59.4),
    ([98, 98, 6, 0, 0], 40.4),
]


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 2)]
    return metrics.confusion(spark.createDataFrame(rows, "true int, pred int"), [0, 1, 2])


def test_confusion_is_dense_and_complete(cells):
    rows = {(r["true"], r["pred"]): r["n"] for r in cells.collect()}
    assert len(rows) == 9 and sum(rows.values()) == 5
    assert rows[(0, 0)] == 2 and rows[(2, 2)] == 0


def test_report(cells):
    rows = {r["label"]: r for r in metrics.report(cells).collect()}
    want = {
        "0": (1.0, 2 / 3, 0.8, 3), "1": (0.5, 0.5, 0.5, 2), "2": (0.0, 0.0, 0.0, 0),
        "macro avg": (0.5, 0.388889, 0.433333, 5), "weighted avg": (0.8, 0.6, 0.68, 5),
    }
    for label, (p, r, f, s) in want.items():
        got = rows[label]
        assert (got["precision"], got["recall"], got["f1"]) == pytest.approx((p, r, f), abs=1e-6)
        assert got["support"] == s
    assert rows["accuracy"]["f1"] == pytest.approx(0.6) and rows["accuracy"]["precision"] is None


def test_empty_class_scores_zero_and_counts(cells):
    rows = {r["true"]: r for r in metrics.per_class(cells).collect()}
    assert rows[2]["accuracy"] == 0.0 and rows[2]["support"] == 0
    row = metrics.macro(metrics.per_class(cells)).head()
    assert row["macro"] == pytest.approx((2 / 3 + 0.5 + 0) / 3) and row["overall"] == pytest.approx(0.6)


def test_marginals(cells):
    got = {r["label"]: (r["n_true"], r["n_pred"]) for r in metrics.marginals(cells).collect()}
    assert got == {0: (3, 2), 1: (2, 2), 2: (0, 1)}


def test_macro_equals_overall_for_equal_classes(spark):
    rows = [(c, c if i < 10 * c else 9) for c in range(4) for i in range(100)]
    cells = metrics.confusion(spark.createDataFrame(rows, "true int, pred int"), [0, 1, 2, 3, 9])
    present = metrics.per_class(cells).where("support > 0")
    row = metrics.macro(present).head()
    assert row["macro"] == pytest.approx(row["overall"])


def test_published_macro_averages(spark):
    rows = [(m, c, 100, a, a / 100) for m, (accs, _) in enumerate(PUBLISHED) for c, a in enumerate(accs)]
    df = spark.createDataFrame(rows, "model int, true int, support long, correct long, accuracy double")
    got = {r["model"]: r["macro"] for r in metrics.macro(df, ["model"]).collect()}
    for m, (_, want) in enumerate(PUBLISHED):
        assert got[m] * 100 == pytest.approx(want, abs=1e-9)


def test_verdict_boundary(spark):
    df = spark.createDataFrame([(0, 0.8), (1, 0.7999)], "true int, accuracy double")
    rows = {r["true"]: r for r in metrics.with_verdict(df, "accuracy").collect()}
    assert rows[0]["verdict"] == "PASS" and rows[0]["gap"] is None
    assert rows[1]["verdict"] == "FAIL" and rows[1]["gap"] == pytest.approx(0.0001)


def test_comparisons(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 0.5)], "true int, accuracy double")
    b = spark.createDataFrame([(0, 0.75), (1, 0.75)], "true int, accuracy double")
    assert {r["true"]: r["delta"] for r in metrics.compare(a, b).collect()} == {0: -0.25, 1: 0.25}
    counts = spark.createDataFrame([(0, 9000), (1, 52)], "true int, n long")
    rare = metrics.critical_classes(a, counts, 1000).collect()
    assert [(r["true"], r["n_train"]) for r in rare] == [(1, 52)]
    size = {r["size"]: r["max_accuracy"] for r in metrics.size_versus_accuracy(a, counts, 1000).collect()}
    assert size == {"at_or_above": 1.0, "below": 0.5}


def test_real_versus_generated(spark):
    rows = [("real", 0, 0), ("real", 1, 1), ("generated", 0, 0), ("generated", 1, 0)]
    df = spark.createDataFrame(rows, "source string, true int, pred int")
    row = metrics.real_versus_generated(df).head()
    assert (row["acc_real"], row["acc_generated"], row["difference"]) == (1.0, 0.5, 0.5)


@pytest.mark.parametrize("as_table", [True, False])
def test_thousands_of_classes(spark, as_table):
    """A sparse matrix gives the report that numpy gives."""
    k, n = 5000, 20_000
    rng = np.random.default_rng(5)
    true = rng.integers(0, k - 500, n)  # the last classes have no rows
    pred = np.where(rng.random(n) < 0.6, true, rng.integers(0, k, n))
    df = spark.createDataFrame([("m", int(a), int(b)) for a, b in zip(true, pred)], "model string, true int, pred int")
    classes = spark.range(k).select(F.col("id").cast("int").alias("label")) if as_table else list(range(k))
    cells = metrics.confusion(df, classes, by=["model"]).cache()
    assert cells.count() < n + k and cells.agg(F.sum("n")).head()[0] == n
    hits = np.bincount(true[true == pred], minlength=k)
    support, predicted = np.bincount(true, minlength=k), np.bincount(pred, minlength=k)
    recall = hits / np.maximum(support, 1)
    f1 = 2 * hits / np.maximum(support + predicted, 1)
    scores = metrics.per_class(cells, ["model"])
    assert scores.count() == k
    row = metrics.macro(scores, ["model"]).head()
    assert row["macro"] == pytest.approx(recall.mean()) and row["overall"] == pytest.approx(hits.sum() / n)
    lines = {r["label"]: r for r in metrics.report(cells, ["model"]).collect()}
    assert len(lines) == k + 3
    assert lines["macro avg"]["f1"] == pytest.approx(f1.mean())
    assert lines["weighted avg"]["f1"] == pytest.approx((f1 * support).sum() / n)
    sides = {r["label"]: (r["n_true"], r["n_pred"]) for r in metrics.marginals(cells, ["model"]).collect()}
    assert sides == {i: (support[i], predicted[i]) for i in range(k)}


def test_sparse_and_dense_agree(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 2), (1, 2)], "true int, pred int")
    dense, sparse = metrics.confusion(df, [0, 1, 2, 3]), metrics.confusion(df, [0, 1, 2, 3], max_classes=2)
    assert dense.count() == 16 and sparse.count() == 6
    for figure in (metrics.per_class, metrics.report, metrics.marginals):
        assert sorted(map(str, figure(dense).collect())) == sorted(map(str, figure(sparse).collect()))


LOG = "run_id string, epoch int, step int, inner int, metric string, value double, n_rows int"


def test_epoch_means(spark):
    rows = [("r", 0, 1, i, "d", float(i + 1), 10) for i in range(3)]
    rows += [("r", 0, 2, i, "d", 5.0, 30) for i in range(3)]
    log = spark.createDataFrame(rows, LOG)
    assert history.epoch_means_inner(log).head()["loss"] == pytest.approx(3.5)
    assert history.epoch_means(log).head()["loss"] == pytest.approx(21 / 6)
    assert history.epoch_means(log, per="row").head()["loss"] == pytest.approx(21 / 120)
    with pytest.raises(ValueError):
        history.epoch_means(log, per="epoch")


def test_final_and_reported_epochs(spark):
    rows = [("r", e, 0, 0, "g", float(100 - e), 1) for e in range(25)]
    epochs = history.epoch_means(spark.createDataFrame(rows, LOG))
    last = history.final_values(epochs).head()
    assert (last["epoch"], last["loss"]) == (24, 76.0)
    assert sorted(r["epoch"] for r in history.report_epochs(epochs).collect()) == [9, 19]
    assert sorted(r["epoch"] for r in history.report_epochs(epochs, 5).collect()) == [4, 9, 14, 19, 24]


def test_elbo_and_bce(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0])],
        "x array<double>, r array<double>, mu array<double>, lv array<double>",
    )
    row = history.elbo(df, "x", "r", "mu", "lv", beta=4.0).head()
    assert (row["recon_loss"], row["kl_loss"], row["total_loss"]) == (4.0, 0.5, 6.0)
    p = spark.createDataFrame([(0.9, 1), (0.1, 0)], "p double, t int")
    assert history.bce(p, "p", "t").head()[0] == pytest.approx(0.105361, abs=1e-6)
    certain = spark.createDataFrame([(0.0, 1)], "p double, t int")
    assert history.bce(certain, "p", "t").head()[0] == 100.0
