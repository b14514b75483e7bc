"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from auditlake.catalog import registry
from tools import check


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql_twin(spark, con, sf, name):
    ok, note = check.compare(spark, con, name, sf)
    assert ok, note


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert {"language", "tp", "fp", "fn", "tn", "f1"} <= set(df.columns)
    assert df.count() == 4
