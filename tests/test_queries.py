"""Every registered query against its SQL, at the smallest scale."""

import pytest

from hearth.plans import catalog
from oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_oracle(spark, sf, name):
    assert_same(catalog.QUERIES[name](spark, sf), sf, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "area"
    assert set(entry.oracle_sql()) <= set(entry.queries())
