"""Every registered query beside its SQL, on whole small tables."""

import re

import pytest

from skewlens.catalog import ORACLES, QUERIES
from tests.oracle_check import compare, duck


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # no pairing of everything with everything, no row-at-a-time Python
    assert not any(node in plan for node in ("CartesianProduct", "BroadcastNestedLoop", "BatchEvalPython"))
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def read_columns(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [set(re.findall(r"(\w+):", found)) for found in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]


def test_scans_read_only_what_is_used(spark, data):
    [split] = read_columns(QUERIES["stratified_split_large"](spark, data))
    assert split == {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"}
    assert all(cols == {"event_type"} for cols in read_columns(QUERIES["class_distribution"](spark, data)))
    [shape] = read_columns(QUERIES["imbalance_ratio"](spark, data))
    assert shape == {"quality", "toxic"}


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 2
    assert driver.queries().keys() >= QUERIES.keys()
    assert driver.oracle_sql().keys() >= ORACLES.keys()
