"""Queries over the given tables, each beside the SQL that states its result."""

from skewlens.catalog import (  # noqa: F401
    profiling,
    encoding,
    drawing,
    neighbors,
    generation,
    judging,
    losses,
    classifiers,
    streams,
)
from skewlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
