"""From raw records to a dataset bundle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.operators import encode, profile
from skewlens.operators.sampling import stratified_split
from skewlens.sources.bundle import write_bundle


@dataclass
class Prepared:
    """Rows ``(key, features, label_idx, split)`` and the tables fitted on the way."""

    rows: DataFrame
    classes: DataFrame
    scaler: DataFrame
    vocabulary: DataFrame

    def write(self, path: str) -> None:
        fitted = {"scaler": self.scaler, "vocabulary": self.vocabulary}
        write_bundle(self.rows, path, self.classes, fitted)


def prepare(
    train: DataFrame,
    test: DataFrame,
    dim: DataFrame,
    categorical: list[str],
    excluded: list[str],
    key: str = "row_id",
    label: str = "label",
    category: str = "category",
    test_size: float = 0.2,
    seed: int = 42,
    fit_scope: str = "all",
) -> Prepared:
    """Map labels, one-hot encode with the training vocabulary, standardise, encode the
    categories and split off validation rows by exact class quotas.

    ``fit_scope='all'`` fits the scaler on all training records, later validation rows
    included; ``'train_only'`` splits first and fits on the remaining training rows.
    A label without a category is an error.
    """
    numerical = profile.numerical_columns(train, categorical, [*excluded, key, category])
    mapped_train = profile.map_category(train, label, dim, category)
    mapped_test = profile.map_category(test, label, dim, category)
    classes = encode.fit_labels(mapped_train, category)
    vocabulary = encode.fit_onehot(train, categorical)
    coded = encode.apply_labels(mapped_train, classes, category)
    split = stratified_split(coded, [key], "label_idx", test_size, seed)
    if fit_scope == "all":
        scaler = encode.fit_scaler(train, numerical)
    elif fit_scope == "train_only":
        scaler = encode.fit_scaler(split.where("split = 'train'"), numerical)
    else:
        raise ValueError("fit_scope is 'all' or 'train_only'")
    held = encode.apply_labels(mapped_test, classes, category).withColumn("split", F.lit("test"))
    wanted = [key, "features", "label_idx", "split"]
    rows = encode.assemble(split, scaler, vocabulary).select(*wanted)
    rows = rows.unionByName(encode.assemble(held, scaler, vocabulary).select(*wanted))
    return Prepared(rows, classes, scaler, vocabulary)
