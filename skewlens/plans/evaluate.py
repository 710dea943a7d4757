"""Evaluate and compare generators by a classifier fitted on real rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.operators import metrics, profile, scoring
from skewlens.session import stage
from skewlens.sources.results import write_eval


@dataclass
class Evaluation:
    """Tables keyed by ``model``."""

    cells: DataFrame
    classes: DataFrame
    summary: DataFrame
    report: DataFrame
    marginals: DataFrame

    def write(self, path: str, fit_on: str) -> None:
        write_eval(path, fit_on, self.summary, self.classes, self.cells)


def measure(predictions: DataFrame, classes: list | DataFrame, max_classes: int = metrics.MAX_CLASSES) -> Evaluation:
    """All metrics of a ``(model, true, pred)`` table from one confusion count."""
    cells = stage(metrics.confusion(predictions, classes, by=["model"], max_classes=max_classes), "confusion")
    scores = metrics.with_verdict(metrics.per_class(cells, ["model"]), "accuracy")
    summary = metrics.with_verdict(metrics.macro(scores, ["model"]), "macro")
    return Evaluation(
        cells, scores, summary, metrics.report(cells, ["model"]), metrics.marginals(cells, ["model"])
    )


def evaluate(
    real: DataFrame,
    generated: DataFrame,
    label: str = "label_idx",
    vec: str = "features",
    fit_on: str = "train",
    trees: int = scoring.N_TREES,
    depth: int | None = None,
    seed: int = scoring.SEED,
    max_classes: int = metrics.MAX_CLASSES,
) -> Evaluation:
    """Fit the forest on one split of ``real`` and judge generated rows by it.

    ``generated`` carries ``model``; all its models are scored in one pass, together with
    the real test rows as model ``real``.
    """
    fit_rows = real.where(F.col("split") == fit_on)
    test = real.where(F.col("split") == "test").select(label, vec, F.lit("real").alias("model"))
    scored = generated.select(label, vec, "model").unionByName(test)
    predicted = scoring.forest_evaluate(fit_rows, scored, label, vec, ["model"], trees, depth, seed)
    return measure(predicted, profile.class_list(real, label, max_classes), max_classes)


def compare(evaluation: Evaluation, a: str, b: str, counts: DataFrame, rare_below: int) -> dict[str, DataFrame]:
    """Change from model ``a`` to model ``b`` per class, the same for the rare classes,
    and accuracy against training size. ``counts`` is ``(true, n)``."""
    change = metrics.compare_models(evaluation.classes, "model", a, b)
    pair = evaluation.classes.where(F.col("model").isin(a, b))
    return {
        "change": change,
        "summary": evaluation.summary.where(F.col("model").isin(a, b)),
        "critical": metrics.critical_classes(change, counts, rare_below),
        "size": metrics.size_versus_accuracy(pair, counts, rare_below),
    }
