"""The registered queries beside their SQL, and the register itself."""

import re

import pytest

from skewlens.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, duck


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, data, name):
    assert compare(QUERIES[name](spark, data), duck(data), ORACLES[name]) is None


def test_register():
    import __spark_entry__ as driver

    numbers = sorted(int(m[1]) for m in (re.match(r"op(\d+)_", q) for q in driver.queries()) if m)
    assert numbers == list(range(1, 14))
    assert "pipeline" in driver.queries()


def test_native_plans(spark, data):
    for name in ("op1_quality_rules", "op2_hash_tree_sharding"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
