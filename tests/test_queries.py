"""Every registered query against its SQL twin, or at least against emptiness, on the smallest tables."""

import pytest
from check import compare
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries

NAMES = list(queries())


def test_every_twin_belongs_to_a_query():
    assert set(oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    if name in oracle_sql():
        assert compare(df, con, oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["metric", "value"] and df.count() == 9
