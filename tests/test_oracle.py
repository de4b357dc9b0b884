"""Every registered query at the smallest scale: equal to DuckDB where SQL can say it, non-empty otherwise."""

import oracle_check as oc
import pytest
from conftest import SF

from bagframe.plans import ORACLE, QUERIES

@pytest.fixture(scope="module")
def con():
    return oc.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, text = oc.compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    assert ok, text


def test_entry_smoke(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
