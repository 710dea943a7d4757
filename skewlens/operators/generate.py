"""Synthetic rows per class: sample grids, keyed noise, stored networks, and a
class-conditional linear-Gaussian generator fitted from distributed moments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewlens.functions.hashing import hash_uniform, noise_vector
from skewlens.functions.vectors import as_doubles, lerp
from skewlens.operators.neighbors import _matrix, rows_by_class
from skewlens.operators.ordering import expand_counts, hash_ordinals
from skewlens.session import stage

#: Bytes of network weights a task is given at a time.
WEIGHT_BYTES = 256 * 1024 * 1024
#: Bytes of moment matrices a task holds before it passes them on.
HELD_BYTES = 64 * 1024 * 1024
#: Bytes of a slice of a moment matrix, and slices put together by one task at a time.
SLICE_BYTES = 1024 * 1024
MERGED_PARTS = 64
#: Elements a vector may have for a full covariance (32 MB); wider ones are sketched.
MAX_DIM = 2048
#: Sketches of a class that one task puts together.
SKETCH_PARTS = 16
#: Samples drawn from one model row at a time.
SAMPLE_CHUNK = 4096


# ---- grids and noise ----------------------------------------------------------------


def grid(classes: DataFrame, n: int | str, out: str = "sample_id") -> DataFrame:
    """One row per class and ordinal: ``n`` rows each, or the count in column ``n``."""
    if isinstance(n, int):
        return expand_counts(classes.withColumn("_count", F.lit(n)), "_count", out).drop("_count")
    return expand_counts(classes, n, out)


def with_noise(df: DataFrame, dim: int, key: list[str], seed: int = 42, out: str = "z") -> DataFrame:
    """Standard normal vector per row, a function of the row key alone."""
    return df.withColumn(out, noise_vector(seed, "noise", dim, *key))


def pair_interpolate(
    real: DataFrame, fake: DataFrame, real_key: str, fake_key: str, vec: str, seed: int = 42
) -> DataFrame:
    """Pair the rows of two tables by shuffled position and blend
    ``a * real + (1 - a) * fake`` with one uniform ``a`` per pair."""
    left = hash_ordinals(real.select(real_key, as_doubles(vec).alias("_real")), [real_key], seed, "real")
    right = hash_ordinals(fake.select(fake_key, as_doubles(vec).alias("_fake")), [fake_key], seed, "fake")
    pairs = left.select("pos", F.col(real_key).alias("real_id"), "_real").join(
        right.select("pos", F.col(fake_key).alias("fake_id"), "_fake"), "pos"
    )
    pairs = pairs.withColumn("alpha", hash_uniform(seed, "alpha", "pos"))
    return pairs.select("pos", "real_id", "fake_id", "alpha", lerp("_fake", "_real", "alpha").alias(vec))


# ---- stored networks ----------------------------------------------------------------

#: One row per output unit of a dense layer.
WEIGHTS_SCHEMA = (
    "layer int, activation string, with_label boolean, unit int, bias double, weights array<double>"
)


def _activate(x: np.ndarray, name: str) -> np.ndarray:
    if name == "relu":
        return np.maximum(x, 0.0)
    if name == "leaky_relu":
        return np.where(x > 0, x, 0.2 * x)
    if name == "sigmoid":
        return 1.0 / (1.0 + np.exp(-x))
    if name == "linear":
        return x
    raise ValueError(f"activation {name}")


def _matrices(units: list) -> tuple[np.ndarray, np.ndarray]:
    units = sorted(units, key=lambda r: r["unit"])
    return np.array([u["weights"] for u in units]).T, np.array([u["bias"] for u in units])


def mlp_forward(
    df: DataFrame,
    z: str,
    code: str,
    num_classes: int,
    weights: DataFrame,
    out: str = "features",
    weight_bytes: int = WEIGHT_BYTES,
) -> DataFrame:
    """Apply a stored dense network to ``z``; layers marked ``with_label`` get the
    one-hot of the class code appended to their input. Serves generators, decoders,
    encoders and discriminators alike; batches are multiplied inside the tasks.

    The layers are cut into blocks of units whose weights fit ``weight_bytes``, and a pass
    over the rows applies as many whole layers, or as large a part of one layer, as that
    allows: a network within the limit takes one pass, and no task or driver ever holds more.
    """
    shapes = weights.groupBy("layer").agg(
        F.first("activation").alias("activation"), F.first("with_label").alias("with_label"),
        F.count(F.lit(1)).alias("units"), F.max(F.size("weights")).alias("width"),
    )
    layers = sorted(shapes.collect(), key=lambda r: r["layer"])
    fields = df.schema.fields
    rows = df.withColumn("_in", as_doubles(z)).withColumn("_out", F.array().cast("array<double>"))
    steps, held = [], 0  # (layer, first unit, end, last part of its layer)
    passes = [steps]
    for shape in layers:
        unit_bytes = 8 * (shape["width"] + 1)
        fit = max(1, weight_bytes // unit_bytes)
        if shape["units"] <= fit and held + shape["units"] * unit_bytes > weight_bytes or shape["units"] > fit and steps:
            steps, held = [], 0
            passes.append(steps)
        for at in range(0, shape["units"], fit):
            upto = min(at + fit, shape["units"])
            if at:
                steps, held = [], 0
                passes.append(steps)
            steps.append((shape, at, upto, upto == shape["units"]))
            held += (upto - at) * unit_bytes
    for i, steps in enumerate(passes):
        rows = _dense(rows, code, num_classes, weights, steps)
        if i + 1 < len(passes):
            rows = stage(rows, "layer")
    return rows.select(*[F.col(f.name) for f in fields if f.name != out], F.col("_in").alias(out))


def _dense(rows: DataFrame, code: str, num_classes: int, weights: DataFrame, steps: list) -> DataFrame:
    """One pass: the units of ``steps`` over ``_in``; a layer's outputs gather in ``_out`` and
    become ``_in`` with its last part. Units are those by rank of ``unit``."""
    parts = []
    for shape, at, upto, whole in steps:
        of_layer = weights.where(F.col("layer") == shape["layer"])
        if (at, upto) != (0, shape["units"]):
            of_layer = of_layer.where(F.col("unit").between(at, upto - 1))
        parts.append((*_matrices(of_layer.collect()), shape["activation"], shape["with_label"], whole))
    shared = rows.sparkSession.sparkContext.broadcast(parts)

    def lists(x):
        offsets = np.arange(0, x.size + 1, x.shape[1], dtype="int32") if x.shape[1] else np.zeros(len(x) + 1, "int32")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))

    def forward(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x = _matrix(pa.chunked_array([batch.column("_in")])).astype("float64")
            so_far = _matrix(pa.chunked_array([batch.column("_out")])).reshape(n, -1)
            label = np.zeros((n, num_classes))
            label[np.arange(n), batch.column(code).to_numpy()] = 1.0
            for w, b, activation, with_label, whole in shared.value:
                given = np.concatenate([x, label], axis=1) if with_label else x
                so_far = np.concatenate([so_far, _activate(given @ w + b, activation)], axis=1)
                if whole:
                    x, so_far = so_far, np.zeros((n, 0))
            columns = [batch.column(c) for c in batch.schema.names if c not in ("_in", "_out")]
            names = [c for c in batch.schema.names if c not in ("_in", "_out")]
            yield pa.RecordBatch.from_arrays(columns + [lists(x), lists(so_far)], names + ["_in", "_out"])

    return rows.mapInArrow(forward, rows.schema)


# ---- class-conditional linear-Gaussian generator --------------------------------------


def _merged(n: np.ndarray, means: np.ndarray, scatters: np.ndarray, at: int):
    """Count, mean and rows ``at..`` of the centred scatter of parts put together.

    Parts are centred on their own means; only differences of means enter, so large means
    do not cancel.
    """
    total = n.sum()
    mean = (n[:, None] * means).sum(0) / total
    off = means - mean
    rows = scatters.sum(0) + np.einsum("t,ti,tj->ij", n, off[:, at : at + scatters.shape[1]], off)
    return total, mean, rows


def moments(df: DataFrame, label: str, vec: str) -> DataFrame:
    """``(label, i, n, mean, scatter)``: per class the row count, the mean vector and, from
    matrix row i on, a slice of the centred scatter matrix. One pass over the rows.

    Tasks multiply their batches, centred on the batch's mean, and forward one small matrix
    per class in slices; slices are put together on the cluster in two levels, so no task
    gathers those of all others.
    """
    rows = df.where(F.col(label).isNotNull()).select(label, as_doubles(vec).alias("_vec"))
    kind = rows.schema[label].dataType
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [
            T.StructField(label, kind),
            T.StructField("i", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("mean", vector),
            T.StructField("scatter", vector),
        ]
    )

    def batch_of(keys, firsts, counts, means, slices):
        from pyspark.sql.pandas.types import to_arrow_type

        lists = lambda parts: pa.array([p.ravel() for p in parts], pa.list_(pa.float64()))
        columns = [
            pa.array(keys, to_arrow_type(kind)), pa.array(firsts, pa.int32()), pa.array(counts, pa.int64()),
            lists(means), lists(slices),
        ]
        return pa.RecordBatch.from_arrays(columns, [label, "i", "n", "mean", "scatter"])

    def partial(batches):
        held: dict = {}

        def release():
            for key, (n, mean, scatter) in held.items():
                step = max(1, SLICE_BYTES // (8 * len(mean)))
                firsts = list(range(0, len(mean), step))
                yield batch_of(
                    [key] * len(firsts), firsts, [n] * len(firsts), [mean] * len(firsts),
                    [scatter[a : a + step] for a in firsts],
                )
            held.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(pa.chunked_array([batch.column("_vec")]))
            for key, mine in rows_by_class(batch.column(label)):
                part = x[mine]
                mean = part.mean(axis=0)
                part = part - mean
                found = (len(part), mean, part.T @ part)
                if key in held:
                    both = zip(held[key], found)
                    found = _merged(*(np.stack(pair).astype(float) for pair in both), 0)
                held[key] = found
                if len(held) * x.shape[1] ** 2 * 8 > HELD_BYTES:
                    yield from release()
        yield from release()

    def merge(parts: pa.Table) -> pa.Table:
        width = len(parts["mean"][0])
        matrix = lambda c: np.stack([v.values.to_numpy() for v in parts[c]])
        first = parts["i"][0].as_py()
        slices = matrix("scatter").reshape(parts.num_rows, -1, width)
        n, mean, found = _merged(parts["n"].to_numpy().astype(float), matrix("mean"), slices, first)
        return pa.Table.from_batches([batch_of([parts[label][0].as_py()], [first], [int(n)], [mean], [found])])

    tasks = rows.mapInArrow(partial, schema).withColumn("_task", F.spark_partition_id() % MERGED_PARTS)
    return tasks.groupBy(label, "i", "_task").applyInArrow(merge, schema).groupBy(label, "i").applyInArrow(merge, schema)


def class_covariances(df: DataFrame, label: str, vec: str, max_dim: int = MAX_DIM) -> DataFrame:
    """``(label, n, mean, scatter)``: mean vector and flattened centred scatter matrix."""
    width = df.select(F.size(vec)).head()
    if width is not None and width[0] > max_dim:
        raise ValueError(f"covariances of {width[0]} elements are too large; at most {max_dim}")
    slices = F.sort_array(F.collect_list(F.struct("i", "scatter")))
    whole = moments(df, label, vec).groupBy(label).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), slices.alias("_s")
    )
    return whole.select(label, "n", "mean", F.flatten(F.transform("_s", lambda s: s["scatter"])).alias("scatter"))


# ---- wide vectors: sketches instead of covariances --------------------------------------


def _shrunk(rows: np.ndarray, size: int) -> np.ndarray:
    """Frequent directions: at most ``size`` rows with nearly the same second moments. The
    smallest of the singular values kept takes its square off all of them; fewer rows than
    that, or as many as elements, are kept exactly."""
    if len(rows) <= size:
        return rows
    if rows.shape[1] <= size:  # a triangle of all elements holds the moments exactly
        return np.linalg.qr(rows, mode="r")
    square, turns = np.linalg.eigh(rows @ rows.T)
    square, turns = np.maximum(square[::-1], 0.0), turns[:, ::-1]
    kept = np.maximum(square[:size] - square[size], 0.0)
    real = kept > 1e-15 * max(square[0], 1e-300)
    scale = np.sqrt(kept[real] / square[:size][real])
    return (turns[:, :size][:, real] * scale).T @ rows


def _joined(a: tuple, b: tuple, size: int) -> tuple:
    """Two parts ``(n, mean, centred sum of squares by element, sketch)`` put together: the
    difference of their means becomes one more row."""
    n = a[0] + b[0]
    off = b[1] - a[1]
    pull = a[0] * b[0] / n
    rows = np.vstack([a[3], b[3], np.sqrt(pull) * off])
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + pull * off * off, _shrunk(rows, size)


def class_sketches(df: DataFrame, label: str, vec: str, size: int) -> DataFrame:
    """``(label, n, mean, squares, sketch)``: per class the row count, the mean, the centred
    sum of squares of every element, and at most ``size`` rows whose second moments stand
    for those of the centred class. One pass; only sketches leave a task, and they are put
    together in two levels."""
    rows = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(label, as_doubles(vec).alias("_vec"))
    kind = rows.schema[label].dataType
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [T.StructField(label, kind), T.StructField("n", T.LongType())]
        + [T.StructField(c, vector) for c in ("mean", "squares", "sketch")]
    )
    names = [f.name for f in schema.fields]

    def table_of(held: dict):
        from pyspark.sql.pandas.types import to_arrow_type

        lists = lambda k: pa.array([v[k].ravel() for v in held.values()], pa.list_(pa.float64()))
        columns = [pa.array(list(held), to_arrow_type(kind)), pa.array([int(v[0]) for v in held.values()], pa.int64())]
        return pa.RecordBatch.from_arrays(columns + [lists(k) for k in (1, 2, 3)], names)

    def partial(batches):
        held: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(pa.chunked_array([batch.column("_vec")]))
            for key, mine in rows_by_class(batch.column(label)):
                for at in range(0, len(mine), 4 * size):
                    part = x[mine[at : at + 4 * size]]
                    mean = part.mean(axis=0)
                    part = part - mean
                    found = (len(part), mean, (part * part).sum(axis=0), _shrunk(part, size))
                    held[key] = _joined(held[key], found, size) if key in held else found
            if held and len(held) * (size + 2) * x.shape[1] * 8 > HELD_BYTES:
                yield table_of(held)
                held = {}
        if held:
            yield table_of(held)

    def merge(parts: pa.Table) -> pa.Table:
        held = None
        for i in range(parts.num_rows):
            mean, squares, sketch = (parts[c][i].values.to_numpy() for c in ("mean", "squares", "sketch"))
            found = (parts["n"][i].as_py(), mean, squares, sketch.reshape(-1, len(mean)))
            held = found if held is None else _joined(held, found, size)
        return pa.Table.from_batches([table_of({parts[label][0].as_py(): held})])

    tasks = rows.mapInArrow(partial, schema).withColumn("_task", F.spark_partition_id() % SKETCH_PARTS)
    return tasks.groupBy(label, "_task").applyInArrow(merge, schema).groupBy(label).applyInArrow(merge, schema)


def _fit_sketched(df: DataFrame, label: str, vec: str, k: int, shrinkage: float, size: int) -> DataFrame:
    """:func:`fit_latent` from sketches: a class is pulled toward the pooled sketch by
    stacking both, weighted; nothing of (elements x elements) is formed."""
    classes = stage(class_sketches(df, label, vec, size), "sketches")
    fields = [f for f in classes.schema.fields if f.name in (label, "n", "mean")]
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType(fields + [T.StructField("factors", vector), T.StructField("sigma", vector)])

    def pool(batches):
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                squares = batch.column("squares")[i].values.to_numpy()
                sketch = batch.column("sketch")[i].values.to_numpy().reshape(-1, len(squares))
                n = batch.column("n")[i].as_py()
                held = (n, squares, sketch) if held is None else (
                    held[0] + n, held[1] + squares, _shrunk(np.vstack([held[2], sketch]), size)
                )
        if held is not None:
            lists = [pa.array([v.ravel()], pa.list_(pa.float64())) for v in held[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), *lists], ["n", "squares", "sketch"])

    ddl = "n long, squares array<double>, sketch array<double>"
    parts = classes.select("n", "squares", "sketch").mapInArrow(pool, ddl).collect()
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    total, squares, sketch = 0, 0.0, None
    for r in parts:
        total, squares = total + r["n"], squares + np.array(r["squares"])
        rows = np.array(r["sketch"]).reshape(-1, len(r["squares"]))
        sketch = rows if sketch is None else _shrunk(np.vstack([sketch, rows]), size)
    shared = df.sparkSession.sparkContext.broadcast((squares / total, sketch / np.sqrt(total)))

    def decompose(batches):
        pooled_squares, pooled_sketch = shared.value
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                own_squares = batch.column("squares")[i].values.to_numpy() / n
                own = batch.column("sketch")[i].values.to_numpy().reshape(-1, len(own_squares)) / np.sqrt(n)
                pull = shrinkage / (shrinkage + n)
                rows = np.vstack([np.sqrt(1 - pull) * own, np.sqrt(pull) * pooled_sketch])
                _, values, right = np.linalg.svd(rows, full_matrices=False)
                w = (values[:k, None] * right[:k]).T[:, ::-1]  # rising, as the exact way gives them
                spread = (1 - pull) * own_squares + pull * pooled_squares
                left = np.sqrt(np.maximum(spread - (w * w).sum(axis=1), 0.0))
                out.append((w.ravel(), left))
            lists = [pa.array([o[j] for o in out], pa.list_(pa.float64())) for j in (0, 1)]
            columns = [batch.column(c) for c in (label, "n", "mean")]
            yield pa.RecordBatch.from_arrays(columns + lists, [label, "n", "mean", "factors", "sigma"])

    return stage(classes.mapInArrow(decompose, schema), "latent-model")


def fit_latent(
    df: DataFrame,
    label: str,
    vec: str,
    k: int = 8,
    shrinkage: float = 50.0,
    max_dim: int = MAX_DIM,
    sketch_rows: int | None = None,
) -> DataFrame:
    """``(label, n, mean, factors, sigma)``: per class the mean, k linear factors and the
    per-element residual deviation. The rows are read once; the model is a written table.

    A class's covariance is pulled toward the pooled within-class covariance with weight
    ``shrinkage / (shrinkage + n)``, so a class with fewer rows than dimensions borrows
    its shape from all classes. Vectors of more than ``max_dim`` elements are fitted from
    sketches of ``sketch_rows`` rows a class (default: four times k, and 32 more).
    """
    width = df.select(F.size(vec)).where(F.col(vec).isNotNull()).head()
    if width is not None and width[0] > max_dim:
        return _fit_sketched(df, label, vec, k, shrinkage, sketch_rows or 4 * k + 32)
    classes = stage(class_covariances(df, label, vec, max_dim), "covariances")
    pooled_row = classes.agg(
        F.sum("n").alias("n"), Summarizer.sum(array_to_vector(F.col("scatter"))).alias("s")
    ).head()
    fields = [f for f in classes.schema.fields if f.name != "scatter"]
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType(fields + [T.StructField("factors", vector), T.StructField("sigma", vector)])
    if not pooled_row["n"]:
        return df.sparkSession.createDataFrame([], schema)
    pooled = np.asarray(pooled_row["s"].toArray()) / pooled_row["n"]
    shared = df.sparkSession.sparkContext.broadcast(pooled)

    def decompose(batches):
        for pdf in batches:
            factors, sigmas = [], []
            for n, scatter in zip(pdf["n"], pdf["scatter"]):
                d = int(round(np.sqrt(len(scatter))))
                pull = shrinkage / (shrinkage + n)
                cov = (1 - pull) * np.asarray(scatter) / n + pull * shared.value
                cov = cov.reshape(d, d)
                cov = (cov + cov.T) / 2
                values, vectors = np.linalg.eigh(cov)
                top = slice(max(d - k, 0), d)
                w = vectors[:, top] * np.sqrt(np.maximum(values[top], 0.0))
                left = np.maximum(np.diag(cov) - (w * w).sum(axis=1), 0.0)
                factors.append(w.ravel().tolist())
                sigmas.append(np.sqrt(left).tolist())
            yield pdf.drop(columns="scatter").assign(factors=factors, sigma=sigmas)

    return stage(classes.mapInPandas(decompose, schema), "latent-model")


def sample_latent(
    model: DataFrame, label: str, counts: DataFrame | int, seed: int = 42, out: str = "features"
) -> DataFrame:
    """``(label, sample_id, out)``: draw ``mean + factors z + sigma e`` per class.

    ``counts`` is one number for all classes or ``(label, n_samples)``. Each chunk of
    samples is one row carrying its class model, dealt over the cluster and unfolded in
    its task; its random stream depends on (seed, class, chunk) only.
    """
    if isinstance(counts, int):
        asked = model.withColumn("_want", F.lit(counts).cast("long"))
    else:
        asked = model.join(counts.select(label, F.col("n_samples").cast("long").alias("_want")), label)
    parts = int(model.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = (
        asked.where(F.col("_want") > 0)
        .withColumn("_from", F.explode(F.expr(f"sequence(0L, _want - 1, {SAMPLE_CHUNK}L)")))
        .withColumn("_size", F.least(F.col("_want") - F.col("_from"), F.lit(SAMPLE_CHUNK)))
        .withColumn("_stream", F.xxhash64(F.lit(seed), F.col(label), F.col("_from")))
        .select(label, "mean", "factors", "sigma", "_from", "_size", "_stream")
        .repartition(parts)
    )
    schema = T.StructType(
        [
            model.schema[label],
            T.StructField("sample_id", T.LongType()),
            T.StructField(out, T.ArrayType(T.DoubleType())),
        ]
    )

    def draw(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].values.to_numpy()
                mean, sigma = get("mean"), get("sigma")
                d = len(mean)
                w = get("factors").reshape(d, -1)
                n, start = batch.column("_size")[row].as_py(), batch.column("_from")[row].as_py()
                stream = batch.column("_stream")[row].as_py() & 0xFFFFFFFFFFFFFFFF
                rng = np.random.Generator(np.random.Philox(key=stream))
                z = rng.standard_normal((n, w.shape[1]))
                x = mean + z @ w.T + rng.standard_normal((n, d)) * sigma
                offsets = np.arange(0, n * d + 1, d, dtype="int32")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(label)[row].as_py()] * n, batch.schema.field(label).type),
                        pa.array(np.arange(start, start + n)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel())),
                    ],
                    [label, "sample_id", out],
                )

    return chunks.mapInArrow(draw, schema)
