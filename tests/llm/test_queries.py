"""Every query with SQL gives the same rows on Spark and DuckDB; the others give rows."""

import pytest
from oracle import compare
from tests_data import SMALL

from granary.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    if name not in queries.SQL:
        assert queries.QUERIES[name](spark, SMALL).count() > 0
        return
    mine, theirs, a, b = compare(spark, name, queries.QUERIES[name], queries.SQL[name], SMALL)
    assert a == b
    assert mine == theirs
