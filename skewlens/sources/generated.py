"""Generated rows: one folder per class, or one flat table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_class(df: DataFrame, path: str, category: str = "category") -> None:
    df.write.partitionBy(category).parquet(path)


def write_flat(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_by_class(
    spark: SparkSession,
    path: str,
    classes: DataFrame,
    wanted: list | None = None,
    category: str = "category",
) -> DataFrame:
    """Rows of the wanted classes with the class code looked up from the folder name."""
    rows = spark.read.option("basePath", path).parquet(path)
    if wanted is not None:
        rows = rows.where(F.col(category).isin(*wanted))
    codes = classes.select(F.col(category).cast(rows.schema[category].dataType).alias(category), "label_idx")
    return rows.join(codes, category)


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
