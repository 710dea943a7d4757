"""Per-row loss terms over prediction columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skewlens.functions.vectors import _col, squared_error, total

__all__ = ["squared_error", "mean_squared_error", "kl_normal", "binary_cross_entropy", "cross_entropy"]


def mean_squared_error(a: Column | str, b: Column | str) -> Column:
    return squared_error(a, b) / F.size(_col(a))


def kl_normal(mu: Column | str, logvar: Column | str) -> Column:
    """KL divergence of a diagonal normal from the standard normal."""
    terms = F.zip_with(_col(mu), _col(logvar), lambda m, lv: 1.0 + lv - m * m - F.exp(lv))
    return -0.5 * total(terms)


def binary_cross_entropy(p: Column | str, target: Column | str) -> Column:
    """Logarithms are clamped at -100, as the usual neural-network libraries do."""
    p, target = _col(p).cast("double"), _col(target).cast("double")

    def clamped(x: Column) -> Column:
        return F.when(x <= 0, F.lit(-100.0)).otherwise(F.greatest(F.log(x), F.lit(-100.0)))

    return -(target * clamped(p) + (1.0 - target) * clamped(1.0 - p))


def cross_entropy(logits: Column | str, code: Column | str) -> Column:
    """Negative log-softmax at the class code, shifted by the maximum for stability."""
    logits = _col(logits)
    top = F.array_max(logits)
    mass = total(F.transform(logits, lambda x: F.exp(x - top)))
    return F.log(mass) + top - F.get(logits, _col(code))
