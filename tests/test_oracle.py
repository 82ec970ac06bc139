"""Every query with SQL gives the same rows on Spark and DuckDB; the others give rows."""

import pytest
from oracle import compare

from granary import queries as core
from tests_data import SMALL


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query(spark, name):
    if name not in core.SQL:
        assert core.QUERIES[name](spark, SMALL).count() > 0
        return
    mine, theirs, a, b = compare(spark, name, core.QUERIES[name], core.SQL[name], SMALL)
    assert a == b
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
