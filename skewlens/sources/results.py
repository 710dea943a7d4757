"""Append-only tables of evaluation results and runs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from skewlens.session import local_table

RUNS_SCHEMA = (
    "run_id string, kind string, epoch int, params map<string,string>, losses map<string,double>"
)


def write_eval(path: str, fit_on: str, summary: DataFrame, classes: DataFrame, cells: DataFrame) -> None:
    """Append the summary, per-class and confusion rows of an evaluation, with all its
    models (column ``model``) at once.

    Every write has an ``eval_id`` that grows with time; reading takes the latest of each
    model, so writing a model again replaces it.
    """
    eval_id = time.time_ns()
    for name, table in (("summary", summary), ("per_class", classes), ("confusion", cells)):
        tagged = table.select(
            "model",
            F.lit(fit_on).alias("fit_on"),
            F.lit(eval_id).alias("eval_id"),
            *[c for c in table.columns if c != "model"],
        )
        tagged.write.mode("append").parquet(f"{path}/eval_{name}")


def read_eval(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of each model's latest evaluation."""
    rows = spark.read.parquet(f"{path}/eval_{name}")
    latest = rows.groupBy("model", "fit_on").agg(F.max("eval_id").alias("eval_id"))
    return rows.join(latest, ["model", "fit_on", "eval_id"], "left_semi").drop("eval_id")


def eval_record(classes: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """One nested record per evaluation: macro average, accuracies, class names and the
    confusion matrix. A record is k + k*k values for k classes."""
    accuracies = classes.groupBy(*by).agg(
        F.avg("accuracy").alias("macro_avg"),
        F.sort_array(F.collect_list(F.struct("true", "accuracy"))).alias("_a"),
    )
    lines = cells.groupBy(*by, "true").agg(F.sort_array(F.collect_list(F.struct("pred", "n"))).alias("_p"))
    matrix = lines.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("true", "_p"))).alias("_m"))
    return accuracies.join(matrix, by).select(
        *by,
        "macro_avg",
        F.transform("_a", lambda x: x["accuracy"]).alias("per_class_acc"),
        F.transform("_a", lambda x: x["true"].cast("string")).alias("class_names"),
        F.transform("_m", lambda r: F.transform(r["_p"], lambda c: c["n"])).alias("confusion_matrix"),
    )


def append_run(
    spark: SparkSession, path: str, run_id: str, kind: str, epoch: int, params: dict, losses: dict
) -> None:
    row = (run_id, kind, epoch, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in losses.items()})
    append_runs(local_table(spark, [row], RUNS_SCHEMA), path)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Last recorded state of every run."""
    return runs.groupBy("run_id").agg(
        F.max_by("kind", "epoch").alias("kind"),
        F.max("epoch").alias("epoch"),
        F.max_by("params", "epoch").alias("params"),
        F.max_by("losses", "epoch").alias("losses"),
    )
