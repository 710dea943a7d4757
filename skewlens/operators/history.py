"""Training-history tables: ``(run_id, epoch, step, inner, metric, value, n_rows)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.functions.losses import (
    binary_cross_entropy,
    cross_entropy,
    kl_normal,
    mean_squared_error,
    squared_error,
)

_EPOCH = ["run_id", "metric", "epoch"]


def epoch_means(log: DataFrame, per: str = "batch") -> DataFrame:
    """Loss per epoch: step values over the number of batches, or, when steps log sums,
    over the number of rows."""
    if per == "batch":
        mean = F.avg("value")
    elif per == "row":
        mean = F.sum("value") / F.sum("n_rows")
    else:
        raise ValueError("per is 'batch' or 'row'")
    return log.groupBy(*_EPOCH).agg(mean.alias("loss"))


def epoch_means_inner(log: DataFrame) -> DataFrame:
    """Steps with several inner updates: mean inside the step, then over the steps."""
    steps = log.groupBy(*_EPOCH, "step").agg(F.avg("value").alias("value"))
    return steps.groupBy(*_EPOCH).agg(F.avg("value").alias("loss"))


def final_values(epochs: DataFrame) -> DataFrame:
    """Last value of each series."""
    return epochs.groupBy("run_id", "metric").agg(
        F.max("epoch").alias("epoch"), F.max_by("loss", "epoch").alias("loss")
    )


def report_epochs(epochs: DataFrame, every: int = 10) -> DataFrame:
    """Every ``every``-th epoch, counting from one."""
    return epochs.where((F.col("epoch") + 1) % every == 0)


def elbo(df: DataFrame, x: str, recon: str, mu: str, logvar: str, beta: float = 1.0) -> DataFrame:
    """Summed reconstruction error, KL term and their weighted total."""
    sums = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(squared_error(x, recon)).alias("recon_loss"),
        F.sum(kl_normal(mu, logvar)).alias("kl_loss"),
    )
    return sums.withColumn("total_loss", F.col("recon_loss") + beta * F.col("kl_loss"))


def bce(df: DataFrame, p: str, target: str) -> DataFrame:
    return df.agg(F.avg(binary_cross_entropy(p, target)).alias("bce"))


def reconstruction_and_class_loss(
    df: DataFrame, x: str, recon: str, logits: str, code: str, recon_weight: float = 1.0, class_weight: float = 0.1
) -> DataFrame:
    """Mean squared error, cross-entropy and their weighted sum."""
    means = df.agg(
        F.avg(mean_squared_error(x, recon)).alias("recon_loss"),
        F.avg(cross_entropy(logits, code)).alias("class_loss"),
    )
    return means.withColumn(
        "total_loss", recon_weight * F.col("recon_loss") + class_weight * F.col("class_loss")
    )
