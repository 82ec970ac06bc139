import pytest

from granary.plans.sql_surface import SqlSurface


@pytest.fixture(scope="module")
def surface(spark):
    s = SqlSurface(spark, {"t": spark.range(1000).selectExpr("id", "id % 7 AS k"), "u": spark.range(20)})
    s.session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where a subquery is too large for a broadcast
    return s


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grouped_subquery_is_joined_by_key(surface):
    df = surface.frame("WITH g AS (SELECT k, max(id) AS Top FROM t GROUP BY k) SELECT u.id, (SELECT Top FROM g WHERE k = u.id) AS TOP FROM u")
    assert "NestedLoop" not in plan(df) and "SortMergeJoin" in plan(df) and df.columns == ["id", "TOP"]
    assert dict(df.collect()) == {i: (max(x for x in range(1000) if x % 7 == i) if i < 7 else None) for i in range(20)}


def test_ungrouped_subquery_is_hashed_by_key_and_raises_on_two_rows(surface):
    df = surface.frame("SELECT u.id, (SELECT k FROM t WHERE t.id = u.id) AS k FROM u")
    assert "NestedLoop" not in plan(df)
    assert dict(df.collect()) == {i: i % 7 for i in range(20)}
    twice = surface.frame("SELECT u.id, (SELECT id FROM t WHERE k = u.id) AS x FROM u")
    assert "NestedLoop" not in plan(twice)
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        twice.collect()


def test_grouping_by_more_than_the_key_still_raises(surface):
    twice = surface.frame("SELECT u.id, (SELECT n FROM (SELECT k, id % 2 AS odd, count(*) AS n FROM t GROUP BY k, id % 2) WHERE k = u.id) AS n FROM u")
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        twice.collect()


def test_a_comparison_without_a_key_stays(surface):
    df = surface.frame("SELECT u.id, (SELECT t.id FROM t WHERE t.id > u.id + 979) AS x FROM u WHERE u.id >= 19")
    assert df.collect()[0][1] == 999
