"""Headerless CSV records with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewlens.session import stage
from skewlens.sources.schema import record_schema


def read_records(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: str
) -> DataFrame:
    """No inference pass; a malformed line fails the job."""
    return (
        spark.read.schema(schema or record_schema())
        .options(header="false", mode="FAILFAST", **options)
        .csv(path)
    )


def write_records(df: DataFrame, path: str) -> None:
    df.write.options(header="false").csv(path)


def with_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Give records without a key a stable one: numbered per input split, then written
    once, so later passes read the same numbers."""
    return stage(df.withColumn(out, F.monotonically_increasing_id()), "records")
