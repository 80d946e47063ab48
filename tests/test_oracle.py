"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.conftest import SF
from tests.oracle import compare, connect

QUERIES = contract.queries()
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = connect(SF)
    yield connection
    connection.close()


def test_registry_is_consistent():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) - set(contract.TEXT_QUERIES) == {"scan_files"}


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(ORACLE) - set(contract.TEXT_ORACLE)))
def test_same_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE[name]) is None


def test_scan_of_the_table_files(spark):
    rows = QUERIES["scan_files"](spark, SF).collect()
    assert len(rows) == 14 and all(len(r.sha256_hash) == 64 for r in rows)
