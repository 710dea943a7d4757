"""Threshold verdicts on accuracies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skewlens.functions.vectors import _col

#: Accuracy a class or a model has to reach.
TARGET = 0.8


def verdict(score: Column | str, target: float = TARGET) -> Column:
    return F.when(_col(score) >= target, F.lit("PASS")).otherwise(F.lit("FAIL"))


def gap_to_target(score: Column | str, target: float = TARGET) -> Column:
    """Missing accuracy, null where the target is met."""
    return F.when(_col(score) < target, F.lit(target) - _col(score))


def percent(share: Column | str, digits: int = 1) -> Column:
    return F.round(_col(share) * 100.0, digits)
