"""Every registered query with SQL gives the rows of its SQL."""

import pytest

from probatio.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_a_document(name, spark):
    rows = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows.count() == rows.select("doc_id").distinct().count() == 1500
