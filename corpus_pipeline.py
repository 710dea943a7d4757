"""Prepare a training corpus: each stage reads what the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``. Empty tables, nulls and repeated rows pass through as
the operators define them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewlens.llm import decontam, langid, mixing, sharding, simhash
from skewlens.session import stage

#: Documents whose language is less certain than this go, as do those without any letter.
LANGUAGE_SCORE = 0.5
SHINGLE, DISTANCE = 3, 3
SHARDS = 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay; ``lang`` is only learned from."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs, model)
    certain = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LANGUAGE_SCORE)
    return found.where(certain).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id."""
    return simhash.one_of_each(docs, SHINGLE, DISTANCE)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix of sources takes them, not at all or up to three times."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus with its size, checksum, shard and place in the shard."""
    return sharding.shard(docs, SHARDS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language id", language),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("source mix", mix),
    ("sharding", shards),
]

#: SQL cannot state fitted models and fingerprints; the tests check run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
