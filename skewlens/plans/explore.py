"""Exploration of a labelled train/test pair."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skewlens.operators import profile


def explore(
    train: DataFrame,
    test: DataFrame,
    dim: DataFrame,
    categorical: list[str],
    excluded: list[str],
    label: str = "label",
    category: str = "category",
    n_describe: int | None = None,
    top: int = 5,
) -> dict[str, DataFrame]:
    """One lazy table per finding: shapes, column roles, missing cells, raw label counts,
    unmapped labels, class distributions side by side, imbalance, numeric summary of the
    features (all, or the first ``n_describe``) and the most frequent categorical values."""
    numerical = profile.numerical_columns(train, categorical, excluded)
    mapped_train = profile.map_category(train, label, dim, category)
    mapped_test = profile.map_category(test, label, dim, category)
    return {
        "shapes": profile.table_shape(train, "train").unionByName(profile.table_shape(test, "test")),
        "roles": profile.column_roles(train, categorical, excluded),
        "missing_train": profile.missing_total(train),
        "missing_test": profile.missing_total(test),
        "labels": profile.value_counts(train, label),
        "unmapped_train": profile.unmapped(train, label, dim),
        "unmapped_test": profile.unmapped(test, label, dim),
        "distribution": profile.compare_distributions(mapped_train, mapped_test, category),
        "imbalance": profile.imbalance_ratio(mapped_train, category),
        "describe": profile.describe(train, numerical[:n_describe]),
        "top_values": profile.top_values(train, categorical, top),
        "vocabulary": profile.vocabulary_difference(train, test, categorical),
    }
