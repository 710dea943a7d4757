"""Name -> (query, SQL) register shared by the catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL where SQL can state it."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_uniform(tag: str, key: str) -> str:
    """SQL of the keyed uniform used by the library."""
    return f"(('0x' || substr(md5('42:{tag}:' || {key}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def sql_normal(tag: str, key: str) -> str:
    digest = f"md5('42:{tag}:' || {key})"
    a = f"(('0x' || substr({digest}, 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370497::DOUBLE"
    b = f"('0x' || substr({digest}, 14, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE"
    return f"(sqrt(-2 * ln({a})) * cos(2 * pi() * {b}))"


def sql_split(table_name: str, key: str, label: str, carry: str) -> str:
    """CTEs ending in ``assigned(carry, label, split)``: exact stratified 80/20 split."""
    return f"""
    src AS (SELECT {carry}, {label} AS label, md5('42:split:' || {key}) AS h FROM {table_name}),
    cls AS (SELECT label, count(*) AS n FROM src GROUP BY label),
    tot AS (SELECT sum(n)::DOUBLE AS total,
                   sum(n)::DOUBLE - ceil(0.2::DOUBLE * sum(n)::DOUBLE) AS n_train FROM cls),
    shr AS (SELECT label, n, n * n_train / total AS share, n_train FROM cls, tot),
    flo AS (SELECT label, n, floor(share) AS f, share - floor(share) AS rest,
                   n_train - sum(floor(share)) OVER () AS spare FROM shr),
    quo AS (SELECT label, n, (f + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= spare
                   THEN 1 ELSE 0 END)::BIGINT AS quota FROM flo),
    assigned AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.label ORDER BY s.h) <= q.quota
                   THEN 'train' ELSE 'val' END AS split FROM src s JOIN quo q USING (label))"""
