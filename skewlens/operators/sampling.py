"""Exact splits, label sampling, class-weighted resampling, balance check."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewlens.functions.hashing import hash_uniform
from skewlens.operators.ordering import (
    DIGITS,
    _bucket_counts,
    hash_ordinals,
    selected,
    sorted_ordinals,
    with_digest,
)
from skewlens.session import pin

#: Chi-square below which sampled labels count as uniform.
UNIFORM_LIMIT = 10.0
#: Draws one source row may serve before its copies are spread over salts.
DRAWS_PER_ROW = 1000


def split_quotas(counts: DataFrame, label: str, test_size: float = 0.2) -> DataFrame:
    """(label, n, quota): training rows per class by largest remainder.

    ``counts`` is ``(label, n)``, one row per class; the total held out is
    ``ceil(test_size * total)``.
    """
    counts = pin(counts.select(label, "n"), name="class-counts")
    total = counts.agg(F.sum("n")).head()[0] or 0
    n_train = total - math.ceil(test_size * total)
    share = F.col("n") * F.lit(float(n_train)) / F.lit(float(max(total, 1)))
    floors = counts.withColumn("_floor", F.floor(share)).withColumn("_rest", share - F.floor(share))
    spare = n_train - (floors.agg(F.sum("_floor")).head()[0] or 0)
    ranked = sorted_ordinals(floors, [F.desc("_rest"), F.col(label)], "_r")
    return ranked.select(
        label, "n", (F.col("_floor") + (F.col("_r") < spare).cast("int")).cast("long").alias("quota")
    )


def stratified_split(
    df: DataFrame,
    key: list[str],
    label: str,
    test_size: float = 0.2,
    seed: int = 42,
    names: tuple = ("train", "val"),
) -> DataFrame:
    """Add ``split``: the first quota rows of each class in keyed-hash order train.

    Only bucket counts are shuffled; rows are compared with their class's cut-off
    digest where they lie, so a class of any size stays spread out. Keys may repeat: quotas
    hold all the same.
    """
    hashed = with_digest(df, key, seed, "split")
    histogram = pin(_bucket_counts(hashed, [label], "_hash", DIGITS), name="buckets")
    counts = histogram.groupBy(label).agg(F.sum("_n").alias("n"))
    quotas = pin(split_quotas(counts, label, test_size).where(F.col("quota") > 0), name="quotas")
    train, held = names
    return selected(hashed, [label], "_hash", quotas, histogram).select(
        *df.columns, F.when(F.col("_in"), train).otherwise(held).alias("split")
    )


def uniform_labels(ids: DataFrame, key: list[str], k: int, seed: int = 42, out: str = "label_idx") -> DataFrame:
    """Independent labels, uniform on 0..k-1, one per row."""
    return ids.withColumn(out, F.floor(hash_uniform(seed, "label", *key) * k).cast("int"))


def chi_square_uniform(counts: DataFrame, n: str = "n") -> DataFrame:
    """Goodness of fit of class counts (zero classes included) to a uniform split."""
    total = counts.agg((F.sum(n) / F.count(F.lit(1))).alias("e")).scalar()
    result = counts.withColumn("_e", total).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.sum(n).alias("n_rows"),
        F.max("_e").alias("expected"),
        F.sum(F.pow(F.col(n) - F.col("_e"), 2) / F.col("_e")).alias("chi_square"),
    )
    return result.select(
        "n_classes",
        "n_rows",
        "expected",
        "chi_square",
        (F.col("n_classes") - 1).alias("dof"),
        (F.col("chi_square") < UNIFORM_LIMIT).alias("is_uniform"),
    )


def salted_join(
    draws: DataFrame, rows: DataFrame, keys: list[str], group: str, per_key: DataFrame, draw_id: str
) -> DataFrame:
    """Inner join of many draws with the rows they name by ``keys`` (``group`` among them).

    ``per_key(group, per_row)`` tells how many draws name one row on average. Where that
    is large, the rows of the group, few as they must be, are repeated over as many salts
    as keep each join key near ``DRAWS_PER_ROW`` draws: no key is hot, no draw is lost.
    """
    salts = per_key.select(
        group, F.greatest(F.ceil(F.col("per_row") / DRAWS_PER_ROW), F.lit(1)).cast("int").alias("_salts")
    )
    left = draws.join(salts, group).withColumn("_salt", F.pmod(F.xxhash64(draw_id), F.col("_salts")).cast("int"))
    right = rows.join(salts, group).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"]).drop("_salt")


#: Slots of [0, 1) by which a uniform number finds its class interval.
SLOTS = 4096


def class_intervals(mass: DataFrame, label: str) -> DataFrame:
    """(label, _lo, _hi, _slot): each class's share of [0, 1), in label order, once for
    every slot it touches."""
    order = Window.orderBy(label)
    total = F.sum("mass").over(Window.partitionBy())
    last = F.row_number().over(order) == F.count(F.lit(1)).over(Window.partitionBy())
    upto = F.when(last, F.lit(1.0)).otherwise(F.sum("mass").over(order) / total)
    shares = mass.select(label, upto.alias("_hi")).withColumn(
        "_lo", F.coalesce(F.lag("_hi").over(order), F.lit(0.0))
    )
    slots = F.sequence(
        F.floor(F.col("_lo") * SLOTS).cast("int"), F.floor(F.col("_hi") * SLOTS).cast("int")
    )
    return pin(shares.withColumn("_slot", F.explode(slots)), name="intervals")


def weighted_resample(
    df: DataFrame,
    key: list[str],
    label: str,
    n: int,
    weights: DataFrame | None = None,
    seed: int = 42,
) -> DataFrame:
    """``n`` draws with replacement where a row's weight is that of its class.

    ``weights(label, weight)`` defaults to one over the class count, which draws every
    class equally often. A draw picks its class by total weight and then a row of the
    class by position, which is the same distribution as drawing rows by weight.
    """
    rows = df.where(F.col(label).isNotNull())
    counts = pin(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")), name="class-counts")
    if weights is None:
        mass = counts.withColumn("mass", F.lit(1.0))
    else:
        mass = counts.join(weights.select(label, "weight"), label).withColumn(
            "mass", F.col("n") * F.col("weight")
        )
    mass = pin(mass, name="class-mass")
    draws = (
        df.sparkSession.range(n)
        .withColumnRenamed("id", "draw_id")
        .withColumn("_u", hash_uniform(seed, "class", "draw_id"))
        .withColumn("_slot", F.floor(F.col("_u") * SLOTS).cast("int"))
        .join(class_intervals(mass, label), "_slot")
        .where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
        .join(counts, label)
        .withColumn("_at", F.floor(hash_uniform(seed, "row", "draw_id") * F.col("n")).cast("long"))
        .select("draw_id", label, "_at")
    )
    total = mass.agg(F.sum("mass")).scalar()
    per_row = mass.select(label, (F.col("mass") / total * n / F.col("n")).alias("per_row"))
    ordered = hash_ordinals(rows, key, seed, "resample", [label], out="_pos")
    picked = salted_join(
        draws, ordered.withColumnRenamed("_pos", "_at"), [label, "_at"], label, per_row, "draw_id"
    )
    return picked.select("draw_id", *df.columns)
