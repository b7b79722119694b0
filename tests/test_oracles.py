"""Every query against its SQL twin."""

import os

import pytest

from checks import compare, oracles, registry

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
# Too few rows at the smallest scale for these to give any.
MAY_BE_EMPTY = {"key_violations"}


@pytest.fixture(scope="module")
def db():
    return compare.connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(registry.all_queries()) == set(oracles.all_oracles())


@pytest.mark.parametrize("name", list(registry.all_queries()))
def test_equals_sql(spark, db, name):
    found = compare.difference(spark, db, SF_DIR, name)
    if found == "no rows" and name in MAY_BE_EMPTY:
        found = None
    assert found is None


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0
