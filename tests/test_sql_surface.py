import pytest

from granary.errors import SearchIndexError
from granary.plans.sql_surface import SqlSurface, check


@pytest.fixture(scope="module")
def surface(spark):
    t = spark.range(1000).selectExpr("id", "id % 7 AS k", "repeat('x', 3000) AS long", "binary('abc') AS b")
    spark.range(3).createOrReplaceTempView("outside")
    return SqlSurface(spark, {"t": t, "u": spark.range(5)})


@pytest.mark.parametrize(
    "statement",
    [
        "DROP TABLE t", "CREATE TEMP VIEW v AS SELECT 1", "INSERT INTO t SELECT 1", "SET x = 1", "CACHE TABLE t", "DESCRIBE t", "EXPLAIN SELECT 1", "SHOW TABLES", "SELECT 1; SELECT 2", "", ";", "not sql",
        "SELECT reflect('java.lang.Math', 'abs', -1)", "SELECT try_reflect('java.lang.System', 'exit', 0)", "SELECT java_method('java.lang.Math', 'abs', -1)", "SELECT id FROM t WHERE id IN (SELECT reflect('a', 'b') FROM u)",
        "SELECT (SELECT max(java_method('a', 'b')) FROM u)", "WITH w AS (SELECT reflect('a', 'b') AS x) SELECT * FROM w", "SELECT * FROM parquet.`/etc`", "SELECT * FROM main.t", "SELECT * FROM read_files('/etc')",
        "SELECT * FROM t ORDER BY reflect('a', 'b')", "SELECT count(*) FROM t GROUP BY id HAVING reflect('a', 'b') = 1", "SELECT input_file_name() FROM t", "USE x", "REFRESH TABLE t", "SELECT transform(id) USING 'cat' FROM t",
        "SELECT * FROM t JOIN u ON reflect('a', 'b') = 1", "SELECT CASE WHEN reflect('a', 'b') = 1 THEN 1 END", "FROM t INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT *", "TRUNCATE TABLE t", "ADD JAR x", "SELECT aggregate(array(1), 0, (a, x) -> reflect('a', 'b'))",
        "SELECT * FROM t, LATERAL (SELECT reflect('a', 'b'))", "SELECT sum(id) OVER (PARTITION BY reflect('a', 'b')) FROM t", "SELECT system.builtin.reflect('a', 'b')",
    ],
)
def test_refused(spark, surface, statement):
    with pytest.raises(SearchIndexError):
        check(spark, statement)


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT k, count(*) AS n FROM t GROUP BY k HAVING count(*) > 1 ORDER BY 1 LIMIT 3;", "WITH a AS (SELECT id FROM t) SELECT * FROM a JOIN u USING (id)", "SELECT id FROM t WHERE id IN (SELECT id FROM u) AND EXISTS (SELECT 1 FROM u WHERE u.id = t.id)",
        "SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS r FROM t", "SELECT id FROM t EXCEPT SELECT id FROM u", "SELECT explode(array(1, 2))", "SELECT * FROM u LATERAL VIEW explode(array(1)) e AS x", "VALUES (1), (2)", "SELECT * FROM range(3)",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r", "SELECT k, sum(id) FROM t GROUP BY ROLLUP (k)", "SELECT * FROM (SELECT k, id FROM t) PIVOT (count(id) FOR k IN (1, 2))", "SELECT * FROM t TABLESAMPLE (5 ROWS)",
        "SELECT DISTINCT k FROM t OFFSET 2", "SELECT (SELECT max(id) FROM u) AS m, CASE WHEN 1 = 1 THEN 'a' END", "SELECT * FROM u CROSS JOIN (SELECT 1 AS one)",
    ],
)
def test_allowed(surface, statement):
    surface.frame(statement).collect()


def test_bounds(surface):
    r = surface.run("SELECT id, long, b FROM t")
    assert len(r.rows) == 500 and r.truncated and r.rows[0][1].endswith("... (+1000 chars)") and r.rows[0][2] == "<3 bytes>"
    assert surface.run("SELECT id FROM u", limit=0).rows == [] and not surface.run("SELECT id FROM u").truncated


def test_outside_is_unreachable(surface):
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        surface.frame("SELECT * FROM outside")


def test_time_limit(surface):
    with pytest.raises(SearchIndexError, match="stopped"):
        surface.run("SELECT count(*) AS n FROM range(100000000000000) WHERE id % 3 = 1", seconds=1)
