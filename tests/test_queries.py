"""Every registered query with SQL gives the same rows as the SQL, on whole tables."""

import os

import pytest
from harness import difference, duck

import __spark_entry__ as entry_module
from firmlens.catalog import REGISTRY

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
CHECKED = sorted(name for name, q in REGISTRY.items() if q.sql)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, name):
    assert difference(REGISTRY[name].run(spark, SF), con, REGISTRY[name].sql) is None


def test_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    rows = entry_module.entry(spark)
    assert rows.columns == ["segment", "gap", "metric", "n", "group_median", "overall_median", "deviation_pct", "opportunity_value"]
