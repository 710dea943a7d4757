"""Arithmetic on ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(vec: Column | str) -> Column:
    return _col(vec).cast("array<double>")


#: Elements written out one by one, which stay inside generated code; beyond that a
#: lambda over the positions keeps the expression short.
UNROLL = 256


def indicators(value: Column, choices: list) -> Column:
    """One element per choice: 1.0 where the value equals it, else 0.0."""
    hit = lambda choice: F.when(choice == value, F.lit(1.0)).otherwise(F.lit(0.0))
    if len(choices) <= UNROLL:
        return F.array(*[hit(F.lit(c)) for c in choices])
    return F.transform(F.array(*[F.lit(c) for c in choices]), lambda c: hit(c))


def one_hot(code: Column | str, size: int) -> Column:
    """k-vector with a single 1.0 at the code; all zeros when the code is null."""
    return indicators(_col(code), list(range(size)))


def condition(vec: Column | str, code: Column | str, size: int) -> Column:
    """Vector followed by the one-hot of its class code."""
    return F.concat(_col(vec), one_hot(code, size))


def total(vec: Column | str) -> Column:
    return F.aggregate(_col(vec), F.lit(0.0), lambda acc, x: acc + x)


def lerp(a: Column | str, b: Column | str, weight: Column | str) -> Column:
    """``a + weight * (b - a)`` element by element."""
    weight = _col(weight)
    return F.zip_with(_col(a), _col(b), lambda x, y: x + weight * (y - x))


def reparameterise(mu: Column | str, logvar: Column | str, eps: Column | str) -> Column:
    """``mu + exp(logvar / 2) * eps`` element by element."""
    scaled = F.zip_with(_col(logvar), _col(eps), lambda lv, e: F.exp(0.5 * lv) * e)
    return F.zip_with(_col(mu), scaled, lambda m, s: m + s)


def relu(vec: Column | str) -> Column:
    return F.transform(_col(vec), lambda x: F.greatest(x, F.lit(0.0)))


def leaky_relu(vec: Column | str, slope: float = 0.2) -> Column:
    return F.transform(_col(vec), lambda x: F.when(x > 0, x).otherwise(x * slope))


def sigmoid(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(x)))


def squared_error(a: Column | str, b: Column | str) -> Column:
    """Sum of squared element differences."""
    return total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_error(a, b))


def l2_norm(vec: Column | str) -> Column:
    return F.sqrt(total(F.transform(_col(vec), lambda x: x * x)))


def unit_norm_penalty(vec: Column | str) -> Column:
    """Squared distance of the L2 norm from one."""
    return F.pow(l2_norm(vec) - 1.0, 2)


def first_k(vec: Column | str, k: int) -> Column:
    return F.slice(_col(vec), 1, k)
