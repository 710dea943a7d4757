"""Balance audit of label sampling, and augmentation of a bundle's rare classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewlens.operators import profile, sampling, smote
from skewlens.operators.ordering import first_batches
from skewlens.sources.bundle import read_bundle, read_params, write_bundle
from skewlens.session import local_table


def audit_sampling(
    rows: DataFrame,
    classes: DataFrame,
    key: str = "row_id",
    label: str = "label_idx",
    stop_after: int = 100,
    n_draws: int = 25_600,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Class shares met in shuffled batches against those of uniform label draws, and the
    chi-square of the latter."""
    spark = rows.sparkSession
    natural = first_batches(rows.select(key, label), [key], stop_after, seed=seed)
    k = classes.count()
    drawn = sampling.uniform_labels(spark.range(n_draws), ["id"], k, seed, label)
    counts = profile.class_counts(drawn, label, classes.select(label))
    return {
        "natural": profile.class_counts_percent(natural, label, classes),
        "uniform": profile.class_counts_percent(drawn, label, classes),
        "chi_square": sampling.chi_square_uniform(counts),
    }


def augment_bundle(
    spark: SparkSession,
    source: str,
    target: str,
    wanted: dict[str, int],
    key: str = "row_id",
    category: str = "category",
    k: int = smote.K_NEIGHBORS,
    seed: int = 42,
) -> DataFrame:
    """Raise the classes named in ``wanted`` to their target sizes in the training split
    and write a new bundle with provenance; other splits are carried over as they are.
    Returns counts before and after."""
    classes = read_params(spark, source, "classes")
    train = read_bundle(spark, source, ["train"]).select(key, "label_idx", "features")
    names = local_table(spark, list(wanted.items()), f"{category} string, target long")
    targets = names.join(classes, category).select("label_idx", "target")
    full = smote.augment(train, key, "label_idx", "features", targets, k, seed).withColumn("split", F.lit("train"))
    rest = read_bundle(spark, source).where("split <> 'train'").select(key, "label_idx", "features", "split")
    rest = rest.withColumn("is_synthetic", F.lit(False))
    write_bundle(
        full.unionByName(rest, allowMissingColumns=True), target, classes, augmentation="smote", targets=wanted
    )
    after = read_bundle(spark, target, ["train"])
    return profile.before_after(train, after, "label_idx", targets)
