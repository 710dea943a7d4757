"""Principal directions of wide tables: randomised block Krylov search and tall-skinny QR.

No matrix of all elements squared is formed anywhere. Passes over the rows return sums of
(elements x directions), put together in two levels on the cluster; the driver keeps the
few directions searched. Singular values come from a QR decomposition of the projected
rows, reduced as a tree of small triangles, so they keep the accuracy of the rows and not
that of their squares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.operators.neighbors import _matrix

#: Directions searched beside the wanted ones.
OVERSAMPLE = 10
#: Blocks of directions kept before the search starts again from the best ones.
BLOCKS = 12
#: Relative change of the wanted values at which the search has settled, and most passes.
SETTLED, PASSES = 1e-11, 200
#: Partial results that reach the driver.
MERGED_PARTS = 32


def tree_reduce(rows: DataFrame, vec: str, partial, merge, shape: tuple) -> np.ndarray | None:
    """``merge`` of what ``partial(matrix of rows, so far)`` makes of all tasks' rows.

    Tasks return one array each; these are merged on the cluster into at most
    ``MERGED_PARTS`` before the last merge. None without rows.
    """

    def of_task(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                held = partial(_matrix(pa.chunked_array([batch.column(0)])), held)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(held).tobytes()], pa.binary())], ["part"])

    def together(table: pa.Table) -> pa.Table:
        found = _merged(table["part"], merge, shape)
        return pa.table([pa.array([found.tobytes()], pa.binary())], names=["part"])

    parts = rows.where(F.col(vec).isNotNull()).select(vec).mapInArrow(of_task, "part binary")
    parts = parts.withColumn("_group", F.spark_partition_id() % MERGED_PARTS)
    found = parts.groupBy("_group").applyInArrow(together, "part binary").toArrow()
    return _merged(found["part"], merge, shape) if found.num_rows else None


def _merged(column: pa.ChunkedArray, merge, shape: tuple) -> np.ndarray:
    arrays = sorted(column.to_pylist())  # one order whatever arrived first
    held = np.frombuffer(arrays[0]).reshape(shape)
    for part in arrays[1:]:
        held = merge(held, np.frombuffer(part).reshape(shape))
    return np.ascontiguousarray(held)


def triangle(rows: DataFrame, vec: str, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of the centred rows times the directions."""
    k = directions.shape[1]

    def corner(stacked):
        r = np.linalg.qr(stacked, mode="r")
        return np.vstack([r, np.zeros((k - len(r), k))])

    def partial(x, held):
        y = (x - mean) @ directions
        return corner(y if held is None else np.vstack([held, y]))

    found = tree_reduce(rows, vec, partial, lambda a, b: corner(np.vstack([a, b])), (k, k))
    return np.zeros((k, k)) if found is None else found


@dataclass
class Principal:
    mean: np.ndarray
    directions: np.ndarray  # orthonormal columns
    singular: np.ndarray  # of the centred rows
    passes: int


def _orthonormal(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    q, r = np.linalg.qr(x)
    size = np.abs(np.diag(r))
    real = size > 1e-12 * max(size.max(initial=0.0), 1e-300)
    q = q[:, real]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0]


def principal(rows: DataFrame, vec: str, k: int, seed: int = 42) -> Principal:
    """The k leading principal directions. Rows with a null vector are left out; a table
    without rows has no directions. Fewer come out where vectors have fewer elements."""
    known = rows.where(F.col(vec).isNotNull())
    first = known.select(F.size(vec)).head()
    if first is None or not first[0]:
        return Principal(np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0)
    d = first[0]
    mean = np.array(known.agg(Summarizer.mean(array_to_vector(F.col(vec)))).head()[0].toArray())
    k, p = min(k, d), min(k + OVERSAMPLE, d)
    passes = 0

    def product(block):
        nonlocal passes
        passes += 1

        def partial(x, held):
            x = x - mean
            found = x.T @ (x @ block)
            return found if held is None else held + found

        return tree_reduce(known, vec, partial, np.add, block.shape)

    random = np.random.default_rng(seed).standard_normal((d, p))
    basis = np.linalg.qr(random)[0]
    images = product(basis)
    before = None
    while True:
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        settled = before is not None and np.abs(values[:k] - before).max() <= SETTLED * max(values[0], 1e-300)
        if basis.shape[1] >= d or settled or passes >= PASSES:
            break
        before = values[:k]
        basis, images = basis @ turns, images @ turns
        if basis.shape[1] > BLOCKS * p:
            basis, images = basis[:, : 2 * p], images[:, : 2 * p]
        turns = np.eye(basis.shape[1])
        # the next block: what the images of the best directions add to the basis
        block = _orthonormal(images[:, :p], basis)[:, : d - basis.shape[1]]
        if not block.shape[1]:
            break
        basis, images = np.column_stack([basis, block]), np.column_stack([images, product(block)])
    aim = basis @ turns[:, :p]
    aim = np.linalg.qr(aim)[0]
    r = triangle(known, vec, mean, aim)
    _, singular, right = np.linalg.svd(r)
    return Principal(mean, aim @ right.T[:, :k], singular[:k], passes + 1)
