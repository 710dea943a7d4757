"""Keyed randomness: every draw is a function of (seed, tag, row key), so results do
not depend on partitioning, retries or the order in which tasks run."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(seed: int, tag: str, *cols: Column | str) -> Column:
    """32 hex digits of md5 over ``seed:tag:key...``."""
    parts = [_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{tag}"), *parts))


#: Hex digits of one draw: 52 bits, which a double holds exactly.
DRAW_DIGITS = 13
_DRAWS = float(16**DRAW_DIGITS)


def _word(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, DRAW_DIGITS), 16, 10).cast("double")


def uniform_of(digest: Column) -> Column:
    """Uniform in [0, 1) from the first 52 bits of a digest."""
    return _word(digest, 1) / F.lit(_DRAWS)


def normal_of(digest: Column) -> Column:
    """Standard normal (Box-Muller) from the first 104 bits of a digest."""
    u1 = (_word(digest, 1) + 1.0) / F.lit(_DRAWS + 1.0)
    u2 = _word(digest, 1 + DRAW_DIGITS) / F.lit(_DRAWS)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def hash_uniform(seed: int, tag: str, *cols: Column | str) -> Column:
    return uniform_of(hash_hex(seed, tag, *cols))


def hash_normal(seed: int, tag: str, *cols: Column | str) -> Column:
    return normal_of(hash_hex(seed, tag, *cols))


def noise_vector(seed: int, tag: str, dim: int, *cols: Column | str) -> Column:
    """``dim`` independent standard normals for the row key ``cols``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda j: hash_normal(seed, tag, *[_col(c) for c in cols], j),
    )
