"""Rare-class augmentation by interpolation between near neighbours of a class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.functions.hashing import hash_uniform
from skewlens.functions.vectors import as_doubles, lerp
from skewlens.operators.neighbors import CELL_ROWS, knn
from skewlens.operators.ordering import expand_counts, hash_ordinals
from skewlens.operators.sampling import salted_join
from skewlens.session import local_table, pin, stage

#: Neighbours considered per row.
K_NEIGHBORS = 5
#: Classes whose list may become a scan filter.
MAX_GROWING = 10_000


def augmentation_plan(df: DataFrame, label: str, targets: DataFrame | dict, k: int = K_NEIGHBORS) -> DataFrame:
    """(label, n, target, n_new) of the classes named in ``targets``.

    A target below the class size, or a class that has to grow with no more than k
    rows, is an error.
    """
    spark = df.sparkSession
    if isinstance(targets, dict):
        kind = df.schema[label].dataType.simpleString()
        targets = local_table(spark, list(targets.items()), f"`{label}` {kind}, target long")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    plan = pin(
        targets.select(label, F.col("target").cast("long").alias("target"))
        .join(counts, label, "left")
        .select(label, F.coalesce("n", F.lit(0)).alias("n"), "target")
        .withColumn("n_new", F.col("target") - F.col("n")),
        name="plan",
    )
    bad = plan.where((F.col("n_new") < 0) | ((F.col("n_new") > 0) & (F.col("n") <= k))).head()
    if bad is not None:
        if bad["n_new"] < 0:
            raise ValueError(f"target {bad['target']} of class {bad[label]} is below its {bad['n']} rows")
        raise ValueError(f"class {bad[label]} has {bad['n']} rows; more than {k} are needed")
    return plan


def synthesize(
    df: DataFrame,
    key: str,
    label: str,
    vec: str,
    targets: DataFrame | dict,
    k: int = K_NEIGHBORS,
    seed: int = 42,
    cell_rows: int = CELL_ROWS,
    max_growing: int = MAX_GROWING,
) -> DataFrame:
    """The synthetic rows only: ``(label, draw, base_id, neighbor_id, lambda, vec)``.

    Draws take a row of the class and one of its k neighbours with replacement and a
    position between the two. Only the rows of growing classes leave the scan: up to
    ``max_growing`` classes are listed in its filter, more are met by a semi-join.
    Neighbours are searched only for rows that were drawn.
    """
    plan = augmentation_plan(df, label, targets, k).where(F.col("n_new") > 0)
    listed = plan.select(label).limit(max_growing + 1).collect()
    if len(listed) <= max_growing:
        growing = df.where(F.col(label).isin([r[0] for r in listed]))
    else:
        growing = df.join(plan.select(label), label, "left_semi")
    rows = stage(
        growing.select(
            label, F.col(key).cast("long").alias("_key"), as_doubles(vec).alias("_vec")
        ),
        "minority",
    )
    draws = (
        expand_counts(plan.select(label, "n", "n_new"), "n_new", "draw")
        .withColumn("_at", F.floor(hash_uniform(seed, "base", label, "draw") * F.col("n")).cast("long"))
        .withColumn("_rank", (F.floor(hash_uniform(seed, "neighbor", label, "draw") * k) + 1).cast("int"))
        .withColumn("lambda", hash_uniform(seed, "lambda", label, "draw"))
        .drop("n", "n_new")
    )
    per_row = plan.select(label, (F.col("n_new") / F.col("n")).alias("per_row"))
    ordered = hash_ordinals(rows.select(label, "_key"), ["_key"], seed, "smote", [label], "_at")
    based = stage(
        salted_join(draws, ordered, [label, "_at"], label, per_row, "draw").drop("_at"), "draws"
    )
    drawn = based.select(label, "_key").distinct()
    near = knn(
        rows, "_key", label, "_vec", k, queries=drawn, cell_rows=cell_rows, seed=seed, with_vectors=True
    ).select(label, "_key", F.col("rank").alias("_rank"), "neighbor_id", "neighbor_vec")
    pairs = near.join(rows, [label, "_key"])
    per_pair = per_row.withColumn("per_row", F.col("per_row") / k)
    return salted_join(based, pairs, [label, "_key", "_rank"], label, per_pair, "draw").select(
        label,
        "draw",
        F.col("_key").alias("base_id"),
        "neighbor_id",
        "lambda",
        lerp("_vec", "neighbor_vec", "lambda").alias(vec),
    )


def augment(
    df: DataFrame,
    key: str,
    label: str,
    vec: str,
    targets: DataFrame | dict,
    k: int = K_NEIGHBORS,
    seed: int = 42,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Original rows followed by the synthetic ones, each with its provenance."""
    new = synthesize(df, key, label, vec, targets, k, seed, cell_rows)
    nothing = F.lit(None)
    original = df.select(
        F.col(key).cast("long").alias(key),
        label,
        as_doubles(vec).alias(vec),
        F.lit(False).alias("is_synthetic"),
        nothing.cast("long").alias("base_id"),
        nothing.cast("long").alias("neighbor_id"),
        nothing.cast("double").alias("lambda"),
    )
    return original.unionByName(
        new.select(
            nothing.cast("long").alias(key),
            label,
            vec,
            F.lit(True).alias("is_synthetic"),
            "base_id",
            "neighbor_id",
            "lambda",
        )
    )
