"""Every registered query against its DuckDB oracle."""

from __future__ import annotations

import os

import pytest

from cohortforge.catalogue import catalogue
from tests.oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalogue()))
def test_query(spark, oracle, name):
    query, sql = catalogue()[name]
    df = query(spark, SF_DIR)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, oracle, sql) == []
