"""Fitted feature transforms: one-hot, standardisation, label codes, assembly.

Fitting yields small parameter tables; applying them is a narrow projection, so a
train table, a test table and a stream share one code path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewlens.functions.vectors import indicators
from skewlens.operators.ordering import sorted_ordinals
from skewlens.operators.profile import cleaned, feature_value_counts
from skewlens.session import bounded_rows, pin

#: Width a dense vector may reach unless the caller allows more; wider vocabularies have
#: the sparse form.
MAX_WIDTH = 20_000


def fit_onehot(df: DataFrame, cols: list[str], max_width: int = MAX_WIDTH) -> DataFrame:
    """(feature, value, position): features in the given order, values ascending. Sorted in
    ranges; beyond ``max_width`` rows it stays a written table."""
    pairs = feature_value_counts(df, cols).select("feature", "value")
    order = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    placed = sorted_ordinals(pairs, [order, F.col("value")], "position")
    return pin(placed.select("feature", "value", F.col("position").cast("int")), max_width, "vocabulary")


def apply_onehot_sparse(df: DataFrame, vocab: DataFrame, cols: list[str], out: str = "onehot") -> DataFrame:
    """``out``: the ascending positions of the ones, for vocabularies of any width.

    One join per column on its value; unseen and null values give no position.
    """
    for i, c in enumerate(cols):
        places = vocab.where(F.col("feature") == c).select(
            F.col("value").alias(f"_v{i}"), F.col("position").alias(f"_p{i}")
        )
        df = df.join(places, F.col(c).cast("string") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    ones = F.sort_array(F.array_compact(F.array(*[F.col(f"_p{i}") for i in range(len(cols))])))
    return df.withColumn(out, ones).drop(*[f"_p{i}" for i in range(len(cols))])


def _onehot_blocks(vocab: DataFrame, max_width: int = MAX_WIDTH) -> list[tuple[str, list[str]]]:
    rows = bounded_rows(vocab.orderBy("position"), max_width, "one-hot vocabulary")
    blocks: dict[str, list[str]] = {}
    for r in rows:
        blocks.setdefault(r["feature"], []).append(r["value"])
    return list(blocks.items())


def onehot_column(vocab: DataFrame, max_width: int = MAX_WIDTH) -> Column:
    """Dense block for the training vocabulary; unseen or null values give zeros."""
    parts = [
        indicators(F.col(feature).cast("string"), values)
        for feature, values in _onehot_blocks(vocab, max_width)
    ]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def apply_onehot(df: DataFrame, vocab: DataFrame, out: str = "onehot", max_width: int = MAX_WIDTH) -> DataFrame:
    return df.withColumn(out, onehot_column(vocab, max_width))


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, position, mean, scale) from one aggregation; population std, and a
    divisor of one where a column does not vary. Null and NaN are left out."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(cleaned(c)).alias(f"m{i}"), F.stddev_pop(cleaned(c)).alias(f"s{i}")]
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(i).alias("position"),
                F.col(f"m{i}").alias("mean"),
                F.when(F.col(f"s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("scale"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return pin(one.select(F.explode(rows).alias("p")).select("p.*"), name="scaler")


def _scaler_rows(params: DataFrame) -> list:
    return bounded_rows(params.orderBy("position"), MAX_WIDTH, "scaler parameters")


def apply_scaler(df: DataFrame, params: DataFrame, suffix: str = "") -> DataFrame:
    return df.withColumns(
        {
            r["feature"] + suffix: (F.col(r["feature"]) - F.lit(r["mean"])) / F.lit(r["scale"])
            for r in _scaler_rows(params)
        }
    )


def invert_scaler(df: DataFrame, params: DataFrame, suffix: str = "") -> DataFrame:
    """Back to original units; reads columns named ``feature + suffix``."""
    return df.withColumns(
        {
            r["feature"]: F.col(r["feature"] + suffix) * F.lit(r["scale"]) + F.lit(r["mean"])
            for r in _scaler_rows(params)
        }
    )


def scaled_column(params: DataFrame) -> Column:
    return F.array(
        *[
            ((F.col(r["feature"]) - F.lit(r["mean"])) / F.lit(r["scale"])).cast("double")
            for r in _scaler_rows(params)
        ]
    )


def assemble(df: DataFrame, params: DataFrame, vocab: DataFrame, out: str = "features") -> DataFrame:
    """Standardised numeric block followed by the one-hot block, in the row itself."""
    return df.withColumn(out, F.concat(scaled_column(params), onehot_column(vocab)))


def feature_names(params: DataFrame, vocab: DataFrame) -> DataFrame:
    """(position, name) of the assembled vector."""
    numeric = params.select("position", F.col("feature").alias("name"))
    width = params.agg(F.count(F.lit(1)).cast("int")).scalar()
    onehot = vocab.select(
        (F.col("position") + width).alias("position"), F.concat_ws("_", "feature", "value").alias("name")
    )
    return numeric.unionByName(onehot)


def fit_labels(df: DataFrame, col: str) -> DataFrame:
    """(label, label_idx): codes 0..k-1 in ascending label order. Labels are sorted in
    ranges, so a column with very many is not gathered in one task."""
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    coded = sorted_ordinals(distinct, [F.col(col)], "label_idx")
    return pin(coded.select(col, F.col("label_idx").cast("int")), name="labels")


def apply_labels(
    df: DataFrame, dim: DataFrame, col: str, on_unseen: str = "error", out: str = "label_idx"
) -> DataFrame:
    """Attach the code; an unseen or null label raises unless ``on_unseen='null'``."""
    codes = dim.select(col, F.col("label_idx").alias("_code"))
    joined = df.join(codes, col, "left")
    code = F.col("_code")
    if on_unseen == "error":
        message = F.concat(F.lit("label without a code: "), F.coalesce(F.col(col).cast("string"), F.lit("null")))
        code = F.coalesce(code, F.raise_error(message).cast("int"))
    return joined.withColumn(out, code).drop("_code")


def decode_labels(df: DataFrame, dim: DataFrame, col: str, code: str = "label_idx") -> DataFrame:
    """Code back to class name."""
    return df.join(dim.select(F.col("label_idx").alias(code), col), code, "left")
