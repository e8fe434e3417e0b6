"""Every registered query next to its SQL, on the smallest given data."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as driver
from compare import difference, oracle_table, spark_table

from gridloom.suite.queries import all_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, name):
    got = spark_table(driver.queries()[name](spark, SF))
    assert got[1]
    assert difference(got, oracle_table(SF, driver.oracle_sql()[name])) is None


def test_entry(spark):
    assert driver.entry(spark).columns == ["segment", "avg_bal", "n"]


def test_no_sql_without_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
