"""Classifier-based evaluation of real and generated rows.

Fitted models are parameters (nodes of trees, coefficients, directions), and rows are
scored from these alone: no model object travels with a task, so scoring works in every
session whatever was run in it before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skewlens.functions.losses import cross_entropy, mean_squared_error, squared_error
from skewlens.functions.vectors import as_doubles, condition, sigmoid, total
from skewlens.operators import decompose, forest
from skewlens.operators.forest import Forest
from skewlens.operators.sampling import stratified_split
from skewlens.session import local_table, stage

#: Trees and seed of the scoring forest.
N_TREES = 100
SEED = 42
#: Buckets of a score by which the rows below it are counted.
SCORE_BUCKETS = 4096
#: Share of the rows that fitted scores are measured on.
HELD_OUT = 0.2

fit_forest = forest.fit


def predict(model: Forest, df: DataFrame, label: str, vec: str, extra: list[str] | None = None) -> DataFrame:
    """``(extra..., true, pred)``."""
    return forest.predict(model, df, label, vec, extra)


def forest_evaluate(
    fit_rows: DataFrame,
    scored: DataFrame,
    label: str,
    vec: str,
    extra: list[str] | None = None,
    trees: int = N_TREES,
    depth: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Fit on real rows, predict another table. Several models' rows may be stacked in
    ``scored`` and told apart by ``extra`` columns: they are scored in one pass."""
    return predict(fit_forest(fit_rows, label, vec, trees, depth, seed), scored, label, vec, extra)


def reconstruct(df: DataFrame, vec: str, k: int, carry: list[str]) -> DataFrame:
    """``(carry..., latent, recon, sq_error)``: encode to k principal directions, decode,
    and measure the squared error of every row. Vectors may be wide: the directions come
    from a randomised decomposition that holds k + p vectors on the driver, no matrix of
    all elements."""
    rows = df.select(*carry, as_doubles(vec).alias("_x"))
    found = decompose.principal(rows, "_x", k)
    mean, basis = found.mean, found.directions

    @F.pandas_udf("latent array<double>, recon array<double>")
    def code(x: pd.Series) -> pd.DataFrame:
        z = (np.stack(x.to_numpy()) - mean) @ basis
        return pd.DataFrame({"latent": list(z), "recon": list(z @ basis.T + mean)})

    coded = rows.withColumn("_c", code("_x"))
    return coded.select(
        *carry,
        F.col("_x").alias(vec),
        F.col("_c.latent").alias("latent"),
        F.col("_c.recon").alias("recon"),
    ).withColumn("sq_error", squared_error(vec, "recon"))


# ---- logistic regression as coefficients ------------------------------------------------


@dataclass
class Linear:
    """One row of coefficients per class, or a single row for two classes."""

    weights: np.ndarray
    bias: np.ndarray
    settled: bool

    def table(self, spark: SparkSession) -> DataFrame:
        """``(unit, bias, weights, settled)``, to be written and read back."""
        rows = [(i, float(b), w.tolist(), self.settled) for i, (b, w) in enumerate(zip(self.bias, self.weights))]
        return local_table(spark, rows, "unit int, bias double, weights array<double>, settled boolean")

    @classmethod
    def of_table(cls, table: DataFrame) -> Linear:
        rows = sorted(table.collect(), key=lambda r: r["unit"])
        return cls(np.array([r["weights"] for r in rows]), np.array([r["bias"] for r in rows]), all(r["settled"] for r in rows))

    def scores(self, vec: str) -> Column:
        """Linear scores of a vector column, one element per row of coefficients."""
        dot = lambda w: total(F.zip_with(vec, F.lit(w.tolist()), lambda x, y: x * y))
        return F.array(*[dot(w) + F.lit(float(b)) for w, b in zip(self.weights, self.bias)])

    def probability(self, vec: str) -> Column:
        """Of the positive one of two classes."""
        return sigmoid(self.scores(vec)[0])


def fit_linear(rows: DataFrame, label: str, vec: str, family: str, max_iter: int) -> Linear:
    """Logistic regression of a double label on an array column. ``settled`` tells whether
    the fit ended by itself before ``max_iter``."""
    learner = LogisticRegression(family=family, labelCol="_label", featuresCol="_features", maxIter=max_iter)
    model = learner.fit(rows.select(F.col(label).alias("_label"), array_to_vector(vec).alias("_features")))
    return Linear(
        np.array(model.coefficientMatrix.toArray()),
        np.array(model.interceptVector.toArray()),
        model.summary.totalIterations < max_iter,
    )


def latent_separability(
    coded: DataFrame,
    key: list[str],
    label: str,
    vec: str,
    recon_weight: float = 1.0,
    class_weight: float = 0.1,
    max_iter: int = 500,
    held_out: float = HELD_OUT,
    seed: int = SEED,
) -> DataFrame:
    """Can the class be read off the latent code? One row per split and class: rows,
    accuracy, mean reconstruction error, mean cross-entropy, their weighted sum, and
    whether the fit has settled.

    The classifier is fitted on the ``train`` rows of a stratified split; ``val`` rows are
    only scored.
    """
    split = stage(stratified_split(coded, key, label, held_out, seed), "separability")
    rows = split.select(
        "split",
        F.col(label).cast("int").alias("true"),
        F.col(label).cast("double").alias("_label"),
        "latent",
        mean_squared_error(vec, "recon").alias("_mse"),
    )
    model = fit_linear(rows.where("split = 'train'"), "_label", "latent", "multinomial", max_iter)
    scored = rows.withColumn("_raw", model.scores("latent")).withColumn("_ce", cross_entropy("_raw", F.col("true")))
    best = F.array_position("_raw", F.array_max("_raw")) - 1
    hit = (best == F.col("true")).cast("double")
    return (
        scored.groupBy("split", F.col("true").alias(label))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(hit).alias("accuracy"),
            F.avg("_mse").alias("recon_loss"),
            F.avg("_ce").alias("class_loss"),
        )
        .withColumn("total_loss", recon_weight * F.col("recon_loss") + class_weight * F.col("class_loss"))
        .withColumn("settled", F.lit(model.settled))
    )


def two_sample_scores(
    real: DataFrame,
    fake: DataFrame,
    real_key: list[str],
    fake_key: list[str],
    label: str,
    vec: str,
    num_classes: int,
    max_iter: int = 500,
    held_out: float = HELD_OUT,
    seed: int = SEED,
) -> DataFrame:
    """``(label, target, split, p_real, settled)``: probability of being real, from a
    classifier that sees the row and its class, trained on real = 1 against generated = 0;
    ``settled`` tells whether its fit has.

    Rows are split by key, stratified by class and side; the classifier is fitted on the
    ``train`` rows only.
    """

    def side(rows: DataFrame, key: list[str], target: int) -> DataFrame:
        name = F.concat_ws(":", F.lit(target), *[F.col(k).cast("string") for k in key])
        stratum = F.concat_ws(":", F.lit(target), F.col(label).cast("string"))
        return rows.select(
            label, as_doubles(vec).alias("_x"), F.lit(target).alias("target"), name.alias("_key"), stratum.alias("_stratum")
        )

    both = stage(side(real, real_key, 1).unionByName(side(fake, fake_key, 0)), "two-sample")
    rows = stratified_split(both, ["_key"], "_stratum", held_out, seed).select(
        label, "target", "split", F.col("target").cast("double").alias("_target"),
        condition("_x", label, num_classes).alias("_features"),
    )
    model = fit_linear(rows.where("split = 'train'"), "_target", "_features", "binomial", max_iter)
    p_real = model.probability("_features").alias("p_real")
    return rows.select(label, "target", "split", p_real, F.lit(model.settled).alias("settled"))


def two_sample_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Per group: rows, mean P(real) on either side, accuracy at 0.5, and the exact area
    under the ROC curve; a side without rows gives null.

    Equal scores are folded once and all figures follow from the folds, so a model behind
    ``scores`` runs once per row. Ranks are counted by score bucket, so no task sorts more
    than one bucket of a group's scores.
    """
    target, s = F.col("target"), F.col("_s")
    steps = stage(
        scores.groupBy(*by, F.col("p_real").alias("_s")).agg(
            F.sum(target).alias("_pos"), F.sum(1 - target).alias("_neg")
        ),
        "score-steps",
    ).withColumn("_b", F.least(F.floor(s * SCORE_BUCKETS), F.lit(SCORE_BUCKETS - 1)))
    buckets = steps.groupBy(*by, "_b").agg(F.sum("_neg").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")
    ahead = buckets.select(*by, "_b", before.alias("_ahead"))
    below = F.sum("_neg").over(Window.partitionBy(*by, "_b").orderBy("_s")) - F.col("_neg")
    ranked = steps.withColumn("_below", below).join(ahead, [*by, "_b"])
    pos, neg = F.col("_pos"), F.col("_neg")
    hits = F.when(s >= 0.5, pos).otherwise(neg)
    won = pos * (F.col("_ahead") + F.col("_below") + neg / 2)
    return ranked.groupBy(*by).agg(
        F.sum(pos + neg).alias("n"),
        F.try_divide(F.sum(pos * s), F.sum(pos)).alias("p_real_on_real"),
        F.try_divide(F.sum(neg * s), F.sum(neg)).alias("p_real_on_generated"),
        (F.sum(hits) / F.sum(pos + neg)).alias("accuracy"),
        F.try_divide(F.sum(won).cast("double"), F.sum(pos).cast("double") * F.sum(neg)).alias("auc"),
    )
