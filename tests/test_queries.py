"""Every registered query against its SQL check."""

import pytest

from conftest import SMALL
from shelfline.plans import check
from shelfline.plans.all import QUERIES


@pytest.fixture(scope="module")
def results(spark):
    return check.compare_all(QUERIES.values(), spark, SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(results, name):
    assert results[name]["problem"] is None


def test_every_query_has_a_check():
    assert [n for n, q in QUERIES.items() if q.sql is None] == []


def test_entry_contract(spark):
    import __spark_entry__ as driver

    assert set(QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
