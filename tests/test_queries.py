"""A few registered queries against their SQL. ``python tests/oracle.py SF_DIR`` checks all of them."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["a03_flow_log_hours", "src03_flow_counts", "w01_w02_w03_features", "m07_calibration", "st01_snk04_streaming_bins"])
def test_query_equals_sql(spark, name):
    got = queries()[name](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
