import random
import re

import pytest
from pyspark.sql import functions as F

from skewlens.operators import generate, profile
from skewlens.operators.ordering import expand_counts
from skewlens.plans import evaluate as ev
from skewlens.plans.explore import explore
from skewlens.plans.prepare import prepare
from skewlens.plans.rebalance import audit_sampling, augment_bundle
from skewlens.session import fresh_path, local_table, pin, shared_dir, stage
from skewlens.sources import bundle, generated, records, results
from skewlens.sources.schema import AUGMENT_TARGETS, CATEGORICAL, NOT_FEATURES, label_dim, record_schema
from skewlens.streaming import balance
from tests.test_profile import TRAIN_LABELS

# Rows per label of the small stand-in for the record files.
MADE = {"normal": 150, "neptune": 90, "satan": 40, "warezclient": 20, "rootkit": 10}


def write_records(path, seed, services, extra=None):
    rng = random.Random(seed)
    lines = []
    for shift, (label, n) in enumerate((MADE | (extra or {})).items()):
        for _ in range(n):
            fields = []
            for f in record_schema().fields[:-2]:
                if f.name == "protocol_type":
                    fields.append(rng.choice(["tcp", "udp"]))
                elif f.name == "service":
                    fields.append(rng.choice(services))
                elif f.name == "flag":
                    fields.append("SF" if shift % 2 else "S0")
                elif f.dataType.typeName() == "double":
                    fields.append(f"{min(1.0, 0.2 * shift + 0.1 * rng.random()):.2f}")
                else:
                    fields.append(str(shift * 10 + rng.randrange(5)))
            lines.append(",".join([*fields, label, str(rng.randrange(21))]))
    rng.shuffle(lines)
    path.write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("records")
    write_records(root / "train.txt", 1, ["http", "smtp", "ftp"])
    write_records(root / "test.txt", 2, ["http", "smtp", "gopher"])
    return str(root / "train.txt"), str(root / "test.txt")


@pytest.fixture(scope="module")
def prepared(spark, files):
    train, test = (records.with_row_id(records.read_records(spark, f)) for f in files)
    out = prepare(train, test, label_dim(spark), CATEGORICAL, NOT_FEATURES)
    path = fresh_path(spark, "bundle")
    out.write(path)
    return out, path


def test_read_records(spark, files, tmp_path):
    df = records.read_records(spark, files[0])
    assert len(df.columns) == 43 and df.count() == sum(MADE.values())
    bad = tmp_path / "bad.txt"
    bad.write_text("x,tcp,http\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        records.read_records(spark, str(bad)).collect()


def test_explore(spark, files):
    train, test = (records.read_records(spark, f) for f in files)
    found = explore(train, test, label_dim(spark), CATEGORICAL, NOT_FEATURES)
    assert {r["table_name"]: (r["n_rows"], r["n_cols"]) for r in found["shapes"].collect()} == {
        "train": (310, 43), "test": (310, 43),
    }
    roles = found["roles"].groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in roles} == {"categorical": 3, "numerical": 38}
    assert found["missing_train"].head()[0] == 0
    assert found["unmapped_train"].count() == 0
    assert found["describe"].count() == 38
    shares = {r["category"]: r["n_train"] for r in found["distribution"].collect()}
    assert shares == {"Normal": 150, "DoS": 90, "Probe": 40, "R2L": 20, "U2R": 10}
    assert {(r["value"], r["seen_in"]) for r in found["vocabulary"].collect()} == {("ftp", "train"), ("gopher", "test")}


def test_prepare_and_bundle(spark, prepared):
    out, path = prepared
    data = bundle.read_bundle(spark, path)
    counts = {r["split"]: r["count"] for r in data.groupBy("split").count().collect()}
    assert counts == {"train": 248, "val": 62, "test": 310}
    meta = bundle.read_meta(spark, path).head()
    assert (meta["input_dim"], meta["num_classes"], meta["augmentation"]) == (38 + 2 + 3 + 2, 5, None)
    names = {r["category"]: r["label_idx"] for r in bundle.read_params(spark, path, "classes").collect()}
    assert names == {"DoS": 0, "Normal": 1, "Probe": 2, "R2L": 3, "U2R": 4}
    assert bundle.read_params(spark, path, "scaler").count() == 38
    whole = data.where("split <> 'test'").agg(F.avg(F.col("features")[0]), F.stddev_pop(F.col("features")[0])).head()
    assert whole[0] == pytest.approx(0.0, abs=1e-9) and whole[1] == pytest.approx(1.0)


def test_only_wanted_splits_are_read(spark, prepared):
    plan = bundle.read_bundle(spark, prepared[1], ["train"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"split#\d+ = train\)\], PushedFilters: \[\]", plan)


def test_published_sizes_end_to_end(spark):
    """As many rows per label as the published training records have: the split quotas,
    the feature width and the augmented total come out as published."""
    labels = local_table(spark, list(TRAIN_LABELS.items()), "label string, n long")
    rows = expand_counts(labels, "n", "i")
    draw = lambda name, k: F.pmod(F.xxhash64("label", "i", F.lit(name)), F.lit(k))
    # Number of values of each categorical feature.
    choices = {"protocol_type": 3, "service": 70, "flag": 11}
    columns = []
    for field in record_schema().fields:
        name = field.name
        if name == "label":
            columns.append(F.col("label"))
        elif name in choices:
            columns.append(F.concat(F.lit("v"), draw(name, choices[name])).alias(name))
        else:
            columns.append(draw(name, 50).cast(field.dataType).alias(name))
    train = records.with_row_id(rows.select(*columns))
    path, grown = fresh_path(spark, "full"), fresh_path(spark, "full-augmented")
    prepare(train, train.limit(0), label_dim(spark), CATEGORICAL, NOT_FEATURES).write(path)
    data = bundle.read_bundle(spark, path)
    counts = {(r["split"], r["label_idx"]): r["count"] for r in data.groupBy("split", "label_idx").count().collect()}
    assert [counts[("train", i)] for i in range(5)] == [36741, 53874, 9325, 796, 42]
    assert sum(n for (split, _), n in counts.items() if split == "val") == 25195
    assert bundle.read_meta(spark, path).head()["input_dim"] == 122
    change = augment_bundle(spark, path, grown, AUGMENT_TARGETS).collect()
    assert {r["label_idx"]: r["n_added"] for r in change} == {0: 0, 1: 0, 2: 0, 3: 4204, 4: 458}
    assert sum(r["n_after"] for r in change) == 105_440


def test_scaler_scope(spark, files):
    train, test = (records.with_row_id(records.read_records(spark, f)) for f in files)
    out = prepare(train, test, label_dim(spark), CATEGORICAL, NOT_FEATURES, fit_scope="train_only")
    row = out.rows.where("split = 'train'").agg(F.avg(F.col("features")[0]), F.stddev_pop(F.col("features")[0])).head()
    assert row[0] == pytest.approx(0.0, abs=1e-9) and row[1] == pytest.approx(1.0)


def test_unmapped_label_stops_preparation(spark, tmp_path):
    write_records(tmp_path / "t.txt", 3, ["http"], {"newattack": 2})
    df = records.with_row_id(records.read_records(spark, str(tmp_path / "t.txt")))
    with pytest.raises(Exception, match="label without a code"):
        prepare(df, df, label_dim(spark), CATEGORICAL, NOT_FEATURES).rows.collect()


def test_audit(spark, prepared):
    out, path = prepared
    train = bundle.read_bundle(spark, path, ["train"])
    found = audit_sampling(train, out.classes, stop_after=0, n_draws=5000)
    natural = {r["category"]: r["n"] for r in found["natural"].collect()}
    assert sum(natural.values()) == 248 and natural["Normal"] == 120
    assert found["chi_square"].head()["n_rows"] == 5000


def test_augment_bundle(spark, prepared):
    path = fresh_path(spark, "augmented")
    change = augment_bundle(spark, prepared[1], path, {"R2L": 50, "U2R": 20})
    rows = {r["label_idx"]: (r["n_before"], r["n_after"], r["n_added"], r["target"]) for r in change.collect()}
    assert rows[3] == (16, 50, 34, 50) and rows[4] == (8, 20, 12, 20) and rows[1] == (120, 120, 0, None)
    back = bundle.read_bundle(spark, path)
    assert back.where("is_synthetic").count() == 46
    assert back.where("split = 'test'").count() == 310
    meta = bundle.read_meta(spark, path).head()
    assert meta["augmentation"] == "smote" and meta["target_samples"] == {"R2L": 50, "U2R": 20}


@pytest.mark.parametrize("fit_on", ["train", "test"])
def test_evaluate_and_compare(spark, prepared, fit_on):
    out, path = prepared
    real = bundle.read_bundle(spark, path)
    train = real.where("split = 'train'")
    model = generate.fit_latent(train, "label_idx", "features", k=5, shrinkage=5.0)
    good = generate.sample_latent(model, "label_idx", 40).withColumn("model", F.lit("good"))
    bad = good.withColumn("features", F.transform("features", lambda x: x * 0)).withColumn("model", F.lit("bad"))
    result = ev.evaluate(real, good.unionByName(bad), fit_on=fit_on, trees=10, depth=6)
    summary = {r["model"]: r for r in result.summary.collect()}
    assert set(summary) == {"good", "bad", "real"}
    assert summary["good"]["macro"] > 0.9 and summary["good"]["verdict"] == "PASS"
    assert summary["bad"]["macro"] == pytest.approx(0.2) and summary["bad"]["verdict"] == "FAIL"
    counts = train.groupBy(F.col("label_idx").alias("true")).agg(F.count("*").alias("n"))
    change = ev.compare(result, "bad", "good", counts, rare_below=20)
    assert change["critical"].count() == 2
    assert change["change"].agg(F.sum("delta")).head()[0] == pytest.approx(
        5 * (summary["good"]["macro"] - summary["bad"]["macro"])
    )
    target = fresh_path(spark, "eval")
    result.write(target, fit_on)
    assert results.read_eval(spark, target, "confusion").count() == 75
    record = results.eval_record(
        results.read_eval(spark, target, "per_class"), results.read_eval(spark, target, "confusion"), ["model"]
    )
    row = record.where("model = 'good'").head()
    assert row["macro_avg"] == pytest.approx(summary["good"]["macro"])
    assert sum(map(sum, row["confusion_matrix"])) == 200 and row["class_names"] == list("01234")


def test_generated_layouts(spark):
    classes = spark.createDataFrame([("DoS", 0), ("Normal", 1)], "category string, label_idx int")
    rows = generate.with_noise(generate.grid(classes, 10), 3, ["label_idx", "sample_id"], out="features")
    path = fresh_path(spark, "gen")
    generated.write_by_class(rows.drop("label_idx"), path)
    back = generated.read_by_class(spark, path, classes, ["DoS"])
    assert back.count() == 10 and back.select("label_idx").distinct().head()[0] == 0
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "category" in plan


def test_runs(spark):
    path = fresh_path(spark, "runs")
    results.append_run(spark, path, "a", "gan", 100, {"noise_dim": 100}, {"g_loss": 1.2})
    results.append_run(spark, path, "a", "gan", 300, {"noise_dim": 100}, {"g_loss": 2.1})
    results.append_run(spark, path, "b", "vae", 50, {"beta": 1.0}, {"loss": 8.4})
    rows = {r["run_id"]: r for r in results.latest_runs(spark.read.parquet(path)).collect()}
    assert rows["a"]["epoch"] == 300 and rows["a"]["losses"] == {"g_loss": 2.1}
    assert rows["b"]["params"] == {"beta": "1.0"}


def test_pin_and_stage(spark):
    assert "LocalTableScan" in pin(spark.range(10))._jdf.queryExecution().executedPlan().toString()
    big = pin(spark.range(100), max_rows=10)
    assert big.count() == 100 and "FileScan" in big._jdf.queryExecution().executedPlan().toString()
    assert stage(spark.range(7)).count() == 7
    assert shared_dir(spark)


def test_stream_over_several_files_and_restart(spark, tmp_path):
    """Later files change earlier windows; a restarted query goes on where it stopped."""
    source = tmp_path / "in"
    schema = "ts timestamp, c string"

    def add(rows):
        spark.createDataFrame(rows, "t string, c string").select(
            F.col("t").cast("timestamp").alias("ts"), "c"
        ).coalesce(1).write.mode("append").parquet(str(source))

    path, state = fresh_path(spark, "s"), fresh_path(spark, "s-state")

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source))
        counts = balance.window_counts(stream, "ts", "c", "1 day", watermark="1 day")
        balance.write_updates(counts, path, state).awaitTermination()
        rows = balance.current_counts(spark, path, ["window_start", "window_end", "c"]).collect()
        return {(r["window_start"].day, r["c"]): r["n"] for r in rows}

    add([("2024-01-01 10:00:00", "a")] * 3 + [("2024-01-01 11:00:00", "b")])
    assert run() == {(1, "a"): 3, (1, "b"): 1}
    add([("2024-01-02 10:00:00", "a"), ("2024-01-01 23:00:00", "a")])
    assert run() == {(1, "a"): 4, (1, "b"): 1, (2, "a"): 1}
    add([("2024-01-09 10:00:00", "b")])
    add([("2024-01-01 12:00:00", "a")])
    assert run()[(9, "b")] == 1


def test_alert_counts_absent_classes(spark):
    rows = [(1, c, n) for c, n in zip("abcd", [10, 20, 30, 40])]
    df = spark.createDataFrame(rows, "w int, c string, n long")
    row = balance.balance_alert(df, ["w"], 5).head()
    assert row["chi_square"] == pytest.approx(50.0) and row["alert"]


def test_window_alerts_fire_once(spark, tmp_path):
    """Verdicts come when the watermark passes a window, not again after a restart, and late
    rows change nothing."""
    from datetime import datetime, timedelta

    from skewlens.streaming import alerts

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = datetime(2024, 1, 1)
    schema = "ts timestamp, c string"

    def give(rows):
        spark.createDataFrame([(day + timedelta(hours=h), c) for h, c in rows], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        found = alerts.window_alerts(stream, "ts", "c", "1 day", 3, watermark="1 hour")
        with alerts.state_store(spark):
            balance.write_rows(found, out, state).awaitTermination()
        return sorted((r["window_start"].day, r["n_rows"], r["chi_square"], r["alert"]) for r in spark.read.schema(alerts.ALERT_SCHEMA).parquet(out).collect())

    give([(1, "a")] * 30 + [(2, "b")] * 2 + [(20, None)])
    assert run() == []  # the first day is open
    give([(25, "a"), (26, "b"), (27, "c")])
    first = (1, 32, pytest.approx((900 + 4) * 3 / 32 - 32), True)
    assert run() == [first]
    assert run() == [first]  # nothing new, nothing again
    give([(3, "b")] * 50 + [(30, "a")])  # late rows of the first day
    assert run() == [first]
    give([(50, "a")])
    assert run() == [first, (2, 4, pytest.approx((4 + 1 + 1) * 3 / 4 - 4), False)]


def test_profile_of_generated_counts(spark):
    counts = profile.class_counts(
        spark.createDataFrame([(0,)], "label_idx int"), "label_idx", spark.createDataFrame([(0,), (1,)], "label_idx int")
    )
    assert {r["label_idx"]: r["n"] for r in counts.collect()} == {0: 1, 1: 0}


def test_bundle_widths(spark):
    classes = spark.createDataFrame([("a", 0)], "category string, label_idx int")
    rows = spark.createDataFrame([([1.0], "train"), ([1.0, 2.0], "train")], "features array<double>, split string")
    with pytest.raises(ValueError, match="1 to 2 elements"):
        bundle.write_bundle(rows, fresh_path(spark, "ragged"), classes)
    path = fresh_path(spark, "none")
    bundle.write_bundle(rows.limit(0), path, classes)
    meta = bundle.read_meta(spark, path).head()
    assert meta["input_dim"] is None and meta["num_classes"] == 1
