"""Dataset bundles: rows partitioned by split, fitted parameters, one meta row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bundle(
    df: DataFrame,
    path: str,
    classes: DataFrame,
    params: dict[str, DataFrame] | None = None,
    augmentation: str | None = None,
    targets: dict | None = None,
    vec: str = "features",
) -> None:
    """``path/data`` by split, ``path/classes``, ``path/<name>`` for each fitted table
    and ``path/meta``. Rows keep whatever provenance columns they carry.

    The width of the vectors is taken from the written table; vectors of several widths
    are an error, and a bundle without rows has a null width."""
    spark = df.sparkSession
    df.write.partitionBy("split").parquet(f"{path}/data")
    widths = (F.min(F.size(vec)).alias("least"), F.max(F.size(vec)).alias("most"))
    width = spark.read.schema(df.select(vec).schema).parquet(f"{path}/data").agg(*widths).head()
    if width["least"] != width["most"]:
        raise ValueError(f"vectors of {width['least']} to {width['most']} elements in one bundle")
    classes.write.parquet(f"{path}/classes")
    for name, table in (params or {}).items():
        table.write.parquet(f"{path}/{name}")
    known = spark.read.parquet(f"{path}/classes")
    target_map = (
        F.create_map(*[F.lit(x) for pair in targets.items() for x in (str(pair[0]), int(pair[1]))])
        if targets
        else F.lit(None)
    )
    meta = spark.range(1).select(
        F.lit(width["least"]).cast("int").alias("input_dim"),
        known.agg(F.count(F.lit(1))).scalar().alias("num_classes"),
        F.lit(augmentation).cast("string").alias("augmentation"),
        target_map.cast("map<string,bigint>").alias("target_samples"),
    )
    meta.write.parquet(f"{path}/meta")


def read_bundle(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """Rows of the wanted splits; other partitions are not opened."""
    data = spark.read.parquet(f"{path}/data")
    return data if splits is None else data.where(F.col("split").isin(*splits))


def read_params(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/meta")
