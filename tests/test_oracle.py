"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from closebook.plans.registry import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    rows, problems = compare(QUERIES[name](spark, folder), duck, ORACLES[name])
    assert not problems
    assert rows >= 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["org_id", "invoice_currency_code", "bucket", "amount"]
    assert df.count() == 60


def test_compare_sees_differences(spark, duck):
    good = spark.sql("SELECT 1 AS a, 'x' AS b")
    assert compare(good, duck, "SELECT 1 AS a, 'x' AS b") == (1, [])
    assert compare(good, duck, "SELECT 2 AS a, 'x' AS b")[1]
    assert compare(good, duck, "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b")[1]
    assert compare(good, duck, "SELECT 1 AS a, 'x' AS c")[1]
    assert compare(good, duck, "SELECT 1 AS a, 'x' AS b UNION ALL SELECT 1, 'x'")[1]
