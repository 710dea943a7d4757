"""Embedding whitening: leading eigenvectors of the covariance by Jacobi-Davidson.

The covariance matrix is never formed. Products with it are Spark jobs over staged blocks of
vectors: each task centres its rows, multiplies them with a few directions and back, and
returns one small sum. Around these products runs the block Jacobi-Davidson method: the
search space is reduced by Rayleigh-Ritz, each open Ritz pair is improved by its projected
correction equation (all of them solved side by side by MINRES, one job a step), pairs whose
residual is at double precision are locked, and the space is restarted when it is full.

Vectors are long integers, so sums, centring (``n * x - S``) and deviations are exact.
Only arrays of (elements x directions) reach the driver, one for each of at most
``defaultParallelism`` tasks, whatever the number of rows.

Defined cases: rows whose vector is null, or holds a null or an element that is not finite,
are dropped; so are vectors shorter than the longest one, since their last elements are
missing; repeated rows count as often as they occur; components without variance are left
out (a constant table, or one without rows, gives no rows); a deviation beyond a long is
null. Ids may be null or repeated. Only id and vector columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skewlens.session import stage

#: Rows of a staged block.
BLOCK_ROWS = 4096
#: Residual of a locked pair, relative to the largest eigenvalue.
TOLERANCE = 256 * np.finfo(float).eps
#: Eigenvalues below this share of the largest one are rounding, not variance.
NO_VARIANCE = 1e-13
#: Directions searched beside the wanted ones, restart size over the wanted number, and
#: bounds of the outer and inner steps.
GUARD, FULL, OUTER, INNER = 4, 4, 100, 8


def fixed_point(df: DataFrame, vec: str, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """Rows with a whole, finite vector, each element ``c`` as ``floor(scale * c) + offset``."""
    value = F.col(vec)
    finite = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = df.where(value.isNotNull() & finite)
    return whole.withColumn(vec, F.transform(vec, lambda c: F.floor(c.cast("double") * scale).cast("long") + offset))


@dataclass
class Vectors:
    """Staged blocks of equal width with their exact sums."""

    blocks: DataFrame
    n: int
    sums: np.ndarray

    @property
    def width(self) -> int:
        return len(self.sums)

    def gather(self, fn, size: int) -> np.ndarray:
        """Sum of ``fn(centred rows)`` over all blocks; one array per task comes back."""
        n, sums = self.n, self.sums
        tasks = max(1, self.blocks.sparkSession.sparkContext.defaultParallelism)

        def partial(batches):
            total = np.zeros(size)
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    total += fn(centred(data, n, sums)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        found = self.blocks.select("data").coalesce(tasks).mapInArrow(partial, "part binary").collect()
        return np.sum([np.frombuffer(r["part"]) for r in found], axis=0) if found else np.zeros(size)

    def product(self, directions: np.ndarray) -> np.ndarray:
        """Covariance times directions (elements x directions)."""
        out = self.gather(lambda x: x.T @ (x @ directions), directions.size)
        return out.reshape(directions.shape) / self.n


def centred(data: bytes, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * np.frombuffer(data, np.int64).reshape(-1, len(sums)) - sums) / n


def stage_vectors(df: DataFrame, vec: str, key: str) -> Vectors:
    """Stage the long vectors of the greatest width as blocks and sum them."""
    rows = df.select(F.col(key), F.col(vec).cast("array<long>").alias("_x"))
    width = rows.agg(F.max(F.size("_x")).alias("w")).head()["w"] or 0
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema[0].dataType)), T.StructField("data", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def blocked(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = pa.array([part.column(0).to_pylist()], arrow.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array([values.tobytes()], pa.binary())], schema=arrow)

    whole = rows.where(F.size("_x") == width) if width else rows.limit(0)
    blocks = stage(whole.mapInArrow(blocked, schema), "vectors")
    tasks = max(1, blocks.sparkSession.sparkContext.defaultParallelism)

    def summed(batches):
        count, total = 0, np.zeros(width, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                x = np.frombuffer(data, np.int64).reshape(-1, width)
                count, total = count + len(x), total + x.sum(axis=0)
        parts = [pa.array([count], pa.int64()), pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(parts, ["n", "part"])

    n, sums = 0, np.zeros(width, np.int64)
    if width:
        for r in blocks.select("data").coalesce(tasks).mapInArrow(summed, "n long, part binary").collect():
            n, sums = n + r["n"], sums + np.frombuffer(r["part"], np.int64)
    return Vectors(blocks, n, sums)


def _against(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``x`` without its parts along an orthonormal basis."""
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


def _orthonormal(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``x`` adds to the basis."""
    kept = basis
    for column in x.T:
        norm = np.linalg.norm(column)
        if norm == 0:
            continue
        column = _against(column / norm, kept)
        rest = np.linalg.norm(column)
        if rest > 1e-10:
            column = _against(column / rest, kept)
            kept = np.column_stack([kept, column / np.linalg.norm(column)])
    return kept[:, basis.shape[1] :]


def minres(product, shifts: np.ndarray, project, rhs: np.ndarray, steps: int, reduce: float) -> np.ndarray:
    """Approximate solutions of ``P (A - shift) P t = rhs``, a column each.

    All columns run the Lanczos recurrence of MINRES side by side, so a step costs one
    product for all of them. Columns stop when the residual fell by ``reduce``.
    """
    d, m = rhs.shape
    beta = np.linalg.norm(rhs, axis=0)
    start = beta.copy()
    scale = np.where(beta > 0, beta, 1)
    v_old, v = np.zeros((d, m)), rhs / scale
    w_old, w = np.zeros((d, m)), np.zeros((d, m))
    x = np.zeros((d, m))
    c_old, c, s_old, s = np.ones(m), np.ones(m), np.zeros(m), np.zeros(m)
    eta, b = beta.copy(), np.zeros(m)
    open_ = beta > 0
    for _ in range(steps):
        if not open_.any():
            break
        y = project(product(v) - shifts * v)
        alpha = np.sum(v * y, axis=0)
        y = y - alpha * v - b * v_old
        b_new = np.linalg.norm(y, axis=0)
        rho_0 = c * alpha - c_old * s * b
        rho_1 = np.hypot(rho_0, b_new)
        rho_2 = s * alpha + c_old * c * b
        rho_3 = s_old * b
        safe = np.where(rho_1 > 0, rho_1, 1)
        c_old, c = c, np.where(rho_1 > 0, rho_0 / safe, 1)
        s_old, s = s, np.where(rho_1 > 0, b_new / safe, 0)
        w_new = (v - rho_3 * w_old - rho_2 * w) / safe
        use = open_ & (rho_1 > 0)
        x = x + np.where(use, c * eta, 0) * w_new
        w_old, w = w, w_new
        eta = -s * eta
        v_old, v = v, y / np.where(b_new > 0, b_new, 1)
        b = b_new
        open_ &= (np.abs(eta) > reduce * start) & (b_new > 1e-14 * start) & (rho_1 > 0)
    return x


@dataclass
class Components:
    """Unit eigenvectors as columns, by falling eigenvalue, with the residual of each."""

    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    products: int


def jacobi_davidson(product, width: int, k: int, seed: int = 42) -> Components:
    """The ``k`` leading eigenpairs of a symmetric operator known by its products."""
    k = min(k, width)
    jobs = 0

    def times(x):
        nonlocal jobs
        jobs += 1
        return product(x)

    rng = np.random.default_rng(seed)
    locked, lock_values, lock_rest = np.zeros((width, 0)), [], []
    space = _orthonormal(rng.standard_normal((width, min(width, k + GUARD))), locked)
    images = times(space)
    top = 0.0
    for outer in range(OUTER):
        small = space.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, turns = values[order], turns[:, order]
        ritz, image = space @ turns, images @ turns
        top = max([top, *np.abs(values[:1]), *np.abs(lock_values)])
        wanted = k - locked.shape[1]
        rest = _against(image[:, :wanted] - values[:wanted] * ritz[:, :wanted], locked)
        norms = np.linalg.norm(rest, axis=0)
        complete = locked.shape[1] + space.shape[1] >= width
        # lock from the front only, so that nothing larger can still be on its way
        done = 0
        while done < min(wanted, len(values)) and (norms[done] <= TOLERANCE * top or complete):
            done += 1
        if done:
            locked = np.column_stack([locked, ritz[:, :done]])
            lock_values += list(values[:done])
            lock_rest += list(norms[:done])
            space, images = ritz[:, done:], image[:, done:]
            images = images - locked @ (locked.T @ images)
            rest, values, ritz = rest[:, done:], values[done:], ritz[:, done:]
            wanted -= done
        if wanted <= 0 or (complete and not space.shape[1]):
            break
        if space.shape[1] > FULL * k:  # restart from the best of the space
            keep = min(space.shape[1], 2 * k)
            if done == 0:
                space, images = ritz, image
            space, images = space[:, :keep], images[:, :keep]
        aim = ritz[:, :wanted]
        held = np.column_stack([locked, aim]) if len(locked) else aim

        def project(t, held=held):
            return _against(t, held)

        shifts = values[:wanted]
        step = minres(times, shifts, project, project(-rest[:, :wanted]), INNER, 0.5 ** (outer + 2))
        new = _orthonormal(step, np.column_stack([locked, space]))
        if not new.shape[1]:  # the space is exact along these, add unseen directions
            new = _orthonormal(rng.standard_normal((width, wanted)), np.column_stack([locked, space]))
        if new.shape[1]:
            added = times(new)
            space = np.column_stack([space, new])
            images = np.column_stack([images, _against(added, locked)])
    else:
        raise RuntimeError(f"residuals of {norms} after {OUTER} steps")
    # a last Rayleigh-Ritz step on fresh products settles order and signs
    images = times(locked)
    small = locked.T @ images
    values, turns = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)
    vectors, image = locked @ turns[:, order], images @ turns[:, order]
    return Components(vectors, values[order], np.linalg.norm(image - values[order] * vectors, axis=0), jobs)


def fit(vectors: Vectors, k: int = 8) -> Components:
    """Leading components with variance."""
    if not vectors.n or not vectors.width:
        return Components(np.zeros((vectors.width, 0)), np.zeros(0), np.zeros(0), 0)
    found = jacobi_davidson(vectors.product, vectors.width, k)
    real = found.values > NO_VARIANCE * max(found.values[0], 0)
    real &= found.values > 0
    return Components(found.vectors[:, real], found.values[real], found.residuals[real], found.products)


def whiten(df: DataFrame, vec: str, key: str, k: int = 8) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``: long vectors
    projected on their leading components, with unit variance along each."""
    vectors = stage_vectors(df, vec, key)
    found = fit(vectors, k)
    n, sums, width = vectors.n, vectors.sums, vectors.width
    count = len(found.values)
    weights = found.vectors / np.sqrt(found.values)
    error, trace = 0.0, 1.0
    if count:
        trace = float(vectors.gather(lambda x: np.array([np.vdot(x, x)]), 1)[0]) / n
        mean = vectors.gather(lambda x: (x @ weights).sum(axis=0), count) / n

        def square(x):
            z = x @ weights - mean
            return z.T @ z

        error = float(np.abs(vectors.gather(square, count * count).reshape(count, count) / n - np.eye(count)).max())
    schema = T.StructType(
        [
            T.StructField(key, vectors.blocks.schema["ids"].dataType.elementType),
            T.StructField("deviation", T.LongType()),
            T.StructField("_z", T.ArrayType(T.DoubleType())),
        ]
    )
    arrow = to_arrow_schema(schema)

    def projected(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                apart = n * np.frombuffer(data, np.int64).reshape(-1, width) - sums
                # int64 arithmetic wraps, so a sum that fits a long is exact
                square = (apart * apart).sum(axis=1)
                rough = np.einsum("ij,ij->i", apart.astype(float), apart.astype(float))
                z = (apart / n) @ weights
                flat = pa.array(z.ravel())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, count, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i].values.cast(arrow.field(0).type),
                        pa.array(square, pa.int64(), mask=rough > 9.2e18),
                        rows.cast(arrow.field(2).type),
                    ],
                    schema=arrow,
                )

    blocks = vectors.blocks if count else vectors.blocks.limit(0)
    shares = F.array(*[F.lit(float(v) / trace) for v in found.values]) if count else F.array(F.lit(0.0))
    rows = blocks.select("ids", "data").mapInArrow(projected, schema)
    at = rows.select(key, "deviation", F.posexplode("_z").alias("_at", "whitened"))
    return at.select(
        key,
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
