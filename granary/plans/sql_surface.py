"""Read-only SQL over given tables: one SELECT, no other plan node, bounded rows, time and cells.

A statement is parsed, and every node and expression of the whole tree is checked
against what reading may need; anything else is refused before analysis. Tables live in a session of
their own, so an outer table cannot be named.
"""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from granary.errors import SearchIndexError

ROW_CAP, SECONDS, CELL_CHARS = 500, 20, 2000

#: Plan nodes a SELECT is parsed into.
NODES = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset Tail Distinct Deduplicate Union Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedRelation UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedWith UnresolvedHaving Window WithWindowDefinition Generate LateralJoin Pivot Unpivot UnresolvedPivot "
    "UnresolvedTableValuedFunction UnresolvedTVFAliases ResolvedInlineTable Sample CTERelationDef UnresolvedHint AsOfJoin UnionLoop Range LimitAll "
    "UnresolvedOrdinal CollectMetrics ParameterizedQuery".split()
)
#: Functions that reach outside of the data.
REFUSED = frozenset(
    "reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user session_user user current_catalog current_database current_schema "
    "version aes_decrypt aes_encrypt try_aes_decrypt raise_error assert_true read_files python_worker_logs spark_partition_id monotonically_increasing_id sql_keywords collations".split()
)
TABLE_FUNCTIONS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple range variant_explode variant_explode_outer".split())


def _children(node) -> list:
    """A node's children, the plans within its subqueries, and those of a WITH."""
    out = []
    for kind in ("children", "innerChildren", "subqueries"):
        try:
            seq = getattr(node, kind)()
        except Exception:
            continue
        out += [seq.apply(i) for i in range(seq.size())]
    return out


def check(spark: SparkSession, statement: str) -> str:
    """The statement without a closing semicolon, or an error that says why it is refused."""
    text = statement.strip().rstrip(";").strip()
    if not text:
        raise SearchIndexError("no statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise SearchIndexError(f"not one readable SELECT: {str(e).splitlines()[0][:300]}") from e
    seen, stack = set(), [plan]
    logical = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    while stack:
        node = stack.pop()
        key = node.hashCode(), node.getClass().getSimpleName()
        if key in seen:
            continue
        seen.add(key)
        name = node.getClass().getSimpleName().rstrip("$")
        is_plan = logical.isInstance(node)
        if is_plan and name not in NODES:
            raise SearchIndexError(f"only SELECT is allowed, not {name}")
        if name == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            if parts.size() != 1:
                raise SearchIndexError(f"tables have plain names, not {parts.mkString('.')}")
        if name in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = node.nameParts() if name == "UnresolvedFunction" else node.name()
            called = parts.last().lower()
            if parts.size() != 1 or called in REFUSED:
                raise SearchIndexError(f"function {parts.mkString('.')} is not allowed")
            if name == "UnresolvedTableValuedFunction" and called not in TABLE_FUNCTIONS:
                raise SearchIndexError(f"table function {called} is not allowed")
        stack += _children(node)
        if is_plan:
            expressions = node.expressions()
            stack += [expressions.apply(i) for i in range(expressions.size())]
        if name == "UnresolvedWith":
            relations = node.cteRelations()
            stack += [relations.apply(i).productElement(1) for i in range(relations.size())]
        if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            stack.append(node.plan())
    return text


def _single(spark: SparkSession, join):
    """A join that allows one match per row, planned by its keys; ``join`` itself if Spark would not compare all pairs, or has to.

    Spark has no sort-merge join that counts matches: where the subquery is too large to broadcast, it compares every
    pair of rows. A subquery with one row per key cannot match twice, so its join is a plain outer one; others are
    hashed by their keys, and still raise where a row matches twice.
    """
    keys = spark._jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys.unapply(join)
    if keys.isEmpty():
        return join
    on, right = _listed(keys.get()._3()), join.right()
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    if any(all(any(k.semanticEquals(x) for x in on) for k in _listed(unique)) for unique in _listed(right.distinctKeys())):
        return join.copy(join.left(), right, catalyst.plans.JoinType.apply("leftouter"), join.condition(), join.hint())
    conf = spark._jsparkSession.sessionState().conf()
    if join.hint().rightHint().isDefined() or right.stats().sizeInBytes() <= conf.autoBroadcastJoinThreshold():
        return join
    some = spark._jvm.scala.Option.apply
    hashed = catalyst.plans.logical.HintInfo(some(getattr(getattr(catalyst.plans.logical, "SHUFFLE_HASH$"), "MODULE$")))
    return join.copy(join.left(), right, join.joinType(), join.condition(), catalyst.plans.logical.JoinHint(join.hint().leftHint(), some(hashed)))


def _listed(scala) -> list:
    out, it = [], scala.iterator()
    while it.hasNext():
        out.append(it.next())
    return out


def _by_keys(spark: SparkSession, node):
    """The plan with joins of correlated scalar subqueries as :func:`_single` has them; ``node`` itself where nothing changes."""
    before = _listed(node.children())
    after = [_by_keys(spark, c) for c in before]
    if any(a is not b for a, b in zip(after, before)):
        node = node.withNewChildren(spark._jvm.PythonUtils.toSeq(after))
    if node.getClass().getSimpleName() == "Join" and node.joinType().sql() == "LEFT SINGLE":
        return _single(spark, node)
    return node


#: Literals and comments are skipped; what is left of MATCH('...') is a table.
_MATCH = re.compile(r"""\bMATCH\s*\(\s*'(?P<match>(?:[^']|'')*)'\s*\)|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.I | re.S)
_ITEM = re.compile(r"""NEAR\s*\(\s*(?P<near>[^,()]+?)\s*,\s*(?P<by>\d+)\s*\)|(?P<not>-|NOT\s+)?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s"()]+))""")


def match_arguments(expression: str) -> dict:
    """A search's arguments from ``word "a phrase" prefix* -without NEAR(a b, 5) this OR that``; what stands side by side must all hold."""
    found: dict[str, list] = {"all": [], "any": [], "not_": [], "phrase": [], "near": []}
    group: list[str] = []
    items = list(_ITEM.finditer(expression))
    bare = lambda i: 0 <= i < len(items) and items[i]["word"] == "OR" and not items[i]["not"]
    for i, m in enumerate(items):
        term = m["phrase"] if m["phrase"] is not None else m["word"]
        if m["near"]:
            found["near"].append((*m["near"].split(), int(m["by"])))
        elif bare(i) or term == "AND":
            continue
        elif m["not"]:
            found["not_"].append(term)
        elif bare(i - 1) or bare(i + 1):
            group.append(term)
            if not bare(i + 1):
                found["any"].append(group)
                group = []
        else:
            found["phrase" if m["phrase"] is not None else "all"].append(term)
    if not any(found.values()):
        raise SearchIndexError("MATCH of nothing")
    return found


@dataclass
class SqlResult:
    columns: list[str]
    rows: list[tuple]
    truncated: bool


class SqlSurface:
    """Tables under plain names, and SELECTs over them."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], index=None):
        """``index``: a search index; with it ``MATCH('...')`` is a table ``(chunk_id, score)`` of the chunks that match."""
        self.outer, self.index, self._matched = spark, index, {}
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        self.session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
        self.session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
        for name, df in tables.items():
            self._add(name, df)

    def _add(self, name: str, df: DataFrame) -> None:
        # The same plan, seen from the session that holds nothing else.
        self._of(df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)

    def _of(self, plan) -> DataFrame:
        return DataFrame(self.session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.session._jsparkSession, plan), self.session)

    def _with_matches(self, statement: str) -> str:
        """The statement with every ``MATCH('...')`` outside of literals and comments made the name of a table of what matches."""

        def table(m: re.Match) -> str:
            if m["match"] is None:
                return m[0]
            if self.index is None:
                raise SearchIndexError("MATCH needs a search index")
            asked = m["match"].replace("''", "'")
            if asked not in self._matched:
                self._matched[asked] = f"match_{len(self._matched) + 1}"
                hits = self.index.search(**match_arguments(asked)).rows.select("chunk_id", "score")
                self._add(self._matched[asked], hits)
            return self._matched[asked]

        return _MATCH.sub(table, statement)

    def frame(self, statement: str) -> DataFrame:
        """The statement's result as a DataFrame, all rows."""
        df = self.session.sql(check(self.session, self._with_matches(statement)))
        patterns = self.session._jvm.org.apache.spark.sql.catalyst.trees.TreePattern
        if not df._jdf.queryExecution().analyzed().containsPattern(patterns.SCALAR_SUBQUERY()):
            return df
        plan = df._jdf.queryExecution().optimizedPlan()
        planned = _by_keys(self.session, plan)
        return df if planned is plan else self._of(planned).toDF(*df.columns)

    def run(self, statement: str, limit: int | None = None, seconds: float = SECONDS, shorten: bool = True) -> SqlResult:
        """At most ``limit`` rows (500 without one, also an upper bound) within ``seconds``; with ``shorten`` long cells are shortened and binary ones described.

        At the time limit the jobs are cancelled. A task inside an operator that does not look for
        cancellation ends only with it; clusters bound that by ``spark.task.reaper.enabled``.
        """
        cap = ROW_CAP if limit is None else max(0, min(limit, ROW_CAP))
        df = self.frame(statement)
        context, group = self.outer.sparkContext, f"sql-{uuid.uuid4().hex}"
        timed_out = threading.Event()

        def stop() -> None:
            timed_out.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(seconds, stop)
        timer.start()
        try:
            context.setJobGroup(group, "bounded SQL", interruptOnCancel=True)
            rows = df.take(cap + 1)
        except Exception as e:
            if timed_out.is_set():
                raise SearchIndexError(f"stopped after {seconds:g} s") from e
            raise
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        return SqlResult(df.columns, [tuple(map(cell, r)) if shorten else tuple(r) for r in rows[:cap]], len(rows) > cap)


def cell(value: object) -> object:
    if isinstance(value, (bytes, bytearray)):
        return f"<{len(value)} bytes>"
    if isinstance(value, str) and len(value) > CELL_CHARS:
        return f"{value[:CELL_CHARS]}... (+{len(value) - CELL_CHARS} chars)"
    return value
