"""Conformance of a backend: independent checks, each with a status and what to do."""

from __future__ import annotations

import difflib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary import schema
from granary.errors import ConnectorError
from granary.functions import prompts
from granary.operators import filters, retrieval
from granary.sources import connectors

PASS, WARN, FAIL, SKIP = "pass", "warn", "fail", "skip"
_PUBLIC = tuple(n for n in dir(connectors.Connector) if not n.startswith("_")) + ("vectors", "run_snapshot")
PROBE_WORDS = 8


def probe_query(chunks: DataFrame) -> str:
    """A question the corpus can answer: the first eight words of its middle chunk by id."""
    n = chunks.count()
    text = chunks.orderBy("chunk_id").offset(n // 2).limit(1).select("text").collect() if n else []
    return " ".join(text[0][0].split()[:PROBE_WORDS]) if text else ""


def validate_connector(
    c: connectors.Connector, queries: DataFrame | None = None, top_k: int = 5, connection: dict | None = None, rebuild: Callable[[], connectors.Connector] | None = None, stability: bool = True,
) -> DataFrame:
    """``(n, name, status, details, fix)``: one row per check, all of them run whatever fails before.

    Without ``queries`` (``query_id`` with ``vector`` or ``text``) a probe is taken from the corpus, for connectors that embed queries.
    ``rebuild`` connects anew with the same connection; without ``stability`` nothing is read twice.
    """
    spark = c.chunks().sparkSession
    if queries is None:
        queries = spark.createDataFrame([("probe", probe_query(c.chunks()))], "query_id string, text string")
    rows: list[tuple] = []

    def check(name: str, test: Callable[[], str | tuple | None], fix: str, need: str | None = None) -> None:
        if need and need not in c.capabilities:
            rows.append((len(rows) + 1, name, SKIP, f"{need} is not declared", ""))
            return
        try:
            found = test()
            status, details = found if isinstance(found, tuple) else (FAIL, found) if found else (PASS, "")
        except ConnectorError as e:
            status, details = FAIL, str(e)
        except Exception as e:  # noqa: BLE001
            status, details = FAIL, f"{type(e).__name__}: {str(e)[:300]}"
        rows.append((len(rows) + 1, name, status, details, fix if status in (FAIL, WARN) else ""))

    info = c.info()
    mode = info.get("retrieval_mode", "scored")
    check("info", lambda: None if isinstance(info, dict) and info.get("name") else "info() names nothing", "return a dict with a name")
    check("retrieval mode", lambda: retrieval.resolve_mode(mode) and None, f"declare one of {', '.join(retrieval.MODES)}")
    check("run snapshot", lambda: connectors.validate_snapshot(c.run_snapshot()) and None, "keep it small and free of secrets", "run_snapshot")
    check("method names", lambda: _shadows(c), "rename the method to the one it resembles")
    chunks = c.chunks()
    check("schema", lambda: _schema(chunks), "serve the columns of the row type")
    check("corpus", lambda: "the corpus is empty" if chunks.isEmpty() else None, "serve the whole corpus")
    check("required fields", lambda: "; ".join(f"{r.rule}: {r.violations}" for r in schema.contract_violations(chunks).collect()) or None, "fill required fields and keep ids unique")
    check("ordinals", lambda: _some(schema.undense_documents(chunks), "doc_id", "ordinals have gaps in"), "number a document's chunks from 0 without gaps")
    check("fingerprints", lambda: _fingerprints(chunks), "carry source_fingerprint in the metadata")
    if stability:
        check("stability", lambda: _differ(chunks, c.chunks()), "serve the same rows to every read")
    check("count", lambda: None if c.count() == chunks.count() else "count() differs from the corpus", "count what is served", "count")
    check("inventory", lambda: _differ(chunks, c.inventory(), ["chunk_id", "doc_id", "doc_chunk_index"]), "list every chunk once", "inventory")
    check("fetch by id", lambda: _fetch(c, chunks), "return exactly the known ids asked for")
    check("health", lambda: None if (h := c.health()).ok else h.detail or "not healthy", "report what is wrong", "health")
    check("snapshot", lambda: None if c.check_snapshot("2000-01-01T00:00:00+00:00").status in ("valid", "out_of_sync", "unknown") else "no such state", "answer valid, out_of_sync or unknown", "check_snapshot")
    check("snapshot needs a zone", lambda: _refuses(lambda: c.check_snapshot("2000-01-01T00:00:00")), "refuse times without a zone", "check_snapshot")
    check("paging", lambda: _pages(c, chunks), "page through every chunk once and end", "pages")
    check("datasets", lambda: "; ".join(f"{d.id!r} binds nothing" for d in c.list_datasets() if not d.id or not d.connect_params) or None, "name the keys that select a dataset", "list_datasets")
    check("query vectors", lambda: _embeds(c, spark), "embed queries in the space of the stored vectors", "embed_queries")
    hits = c.query(queries, top_k)
    check("query", lambda: _hits(hits, chunks, top_k), "return at most top_k rows per query, ranked from 1, with known ids")
    check("score direction", lambda: _direction(hits) if mode == "scored" else None, "higher scores are better: convert distances")
    check("items", lambda: _some(retrieval.item_problems(hits), "query_id", "badly declared items for") if "item_index" in hits.columns else None, "declare items by the rules")
    check("depth of one", lambda: _hits(c.query(queries, 1), chunks, 1), "return one row per query when asked for one")
    check("answer metadata", lambda: None if not c.accepts("answer_metadata") else _same_ids(c, queries, hits, top_k), "let answer metadata choose context, never matches")
    check("prompts", lambda: _prompts(c), "declare valid templates with their block and answers", "prompts")
    check("generate", lambda: _generate(c, queries, chunks), "answer every query and cite known chunks", "generate")
    check("determinism", lambda: _differ(hits, c.query(queries, top_k), ["query_id", "rank", "chunk_id"], WARN), "make the ranking deterministic")
    check("default depth", lambda: "no rows without top_k" if c.query(queries).isEmpty() else None, "serve a default depth")
    check("filter", lambda: _filter(c, queries, chunks, top_k), "apply the filter to every row", "filter")
    check("vectors", lambda: _vectors(c, chunks), "serve stored vectors of known chunks", "vectors")
    check("connection", lambda: (FAIL, f"secrets in {', '.join(p)}") if (p := connectors.secret_paths(connection or {})) else None, "refer to secrets by name")
    if rebuild:
        check("rebuild", lambda: _differ(chunks, rebuild().chunks()), "the connection alone must lead to the same corpus")
    return queries.sparkSession.createDataFrame(rows, "n int, name string, status string, details string, fix string")


def ready(report: DataFrame) -> bool:
    return report.where(F.col("status") == FAIL).isEmpty()


def _refuses(action: Callable[[], object]) -> str | None:
    try:
        action()
    except ConnectorError:
        return None
    return "was accepted"


def _pages(c, chunks: DataFrame) -> str | None:
    """Four pages and a rest: the same ids as the corpus, none twice, and an end."""
    want = chunks.count()
    size, cursor, seen, pages = max(1, want // 4), None, 0, None
    for _ in range(want // size + 2):
        page, following = c.pages(cursor, size)
        seen += page.count()
        pages = page if pages is None else pages.unionByName(page)
        if following is None:
            return None if seen == want and _differ(pages, chunks) is None else f"{seen} rows in pages, {want} in the corpus, or other contents"
        if following == cursor:
            return f"the cursor {cursor!r} does not move"
        cursor = following
    return "paging does not end"


def _embeds(c, spark) -> str | None:
    size = c.space().dimension
    got = c.embed_queries(spark.createDataFrame([("q", "a question")], "query_id string, text string")).first()
    return None if got and size in (None, len(got["vector"])) else f"a vector of {len(got['vector']) if got else 0} numbers, stored are {size}"


def _same_ids(c, queries: DataFrame, hits: DataFrame, top_k: int) -> tuple | None:
    return _differ(hits, c.query(queries, top_k, answer_metadata=[]), ["query_id", "rank", "chunk_id"])


def _prompts(c) -> str | None:
    templates = list(c.prompt_templates())
    if not templates:
        return "prompts are declared and there are none"
    bad = [f"{t.id}: {p}" for t in templates for p in prompts.problems(t)]
    shown = [t.id for t in templates if prompts.render(t, "q\0", "block\0").messages[-1][1].count("block\0") != 1] if not bad else []
    return "; ".join(bad + [f"{i} does not show its block once" for i in shown]) or None


def _said(system: str | None, prompt: str) -> str:
    return '{"answer": "checked", "cited": [1]}'


def _generate(c, queries: DataFrame, chunks: DataFrame) -> str | None:
    if "text" not in queries.columns:
        queries = queries.withColumn("text", F.lit("a question"))
    got = c.generate(queries, _said)
    rows = got.select(F.count_if(F.col("answer").isNull() | F.col("error").isNotNull()).alias("bad"), F.count("*").alias("n")).first()
    if rows["bad"] or rows["n"] != queries.count():
        return f"{rows['bad']} of {rows['n']} answers failed"
    return _some(got.select(F.explode("cited").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_anti"), "chunk_id", "unknown chunks cited:")


def _shadows(c) -> tuple | None:
    own = [n for n in vars(type(c)) if not n.startswith("_") and callable(getattr(c, n)) and n not in _PUBLIC]
    near = [f"{n} resembles {m[0]}" for n in own if (m := difflib.get_close_matches(n, _PUBLIC, 1, 0.6))]
    return (WARN, "; ".join(near)) if near else None


def _schema(chunks: DataFrame) -> str | None:
    kinds, want = dict(chunks.dtypes), {f.name: f.dataType.simpleString() for f in schema.CHUNK.fields}
    bad = [f"{k} is {kinds.get(k, 'missing')}, not {v}" for k, v in want.items() if kinds.get(k) != v]
    return "; ".join(bad) or None


def _some(df: DataFrame, column: str, what: str) -> str | None:
    found = [str(r[0]) for r in df.select(column).limit(5).collect()]
    return f"{what} {', '.join(found)}" if found else None


def _fingerprints(chunks: DataFrame) -> tuple | None:
    value = F.get_json_object("metadata", "$.source_fingerprint")
    n = chunks.where(value.isNull() | (value == "")).count()
    return (WARN, f"{n} chunks without source_fingerprint") if n else None


def _differ(a: DataFrame, b: DataFrame, columns: list[str] | None = None, status: str = FAIL) -> tuple | None:
    columns = columns or ["chunk_id", "doc_id", "text"]
    sums = [d.agg(F.count("*"), F.bit_xor(F.xxhash64(*columns))).first() for d in (a, b)]
    return (status, f"{sums[0][0]} and {sums[1][0]} rows, or other contents") if sums[0] != sums[1] else None


def _fetch(c, chunks: DataFrame) -> str | None:
    ids = chunks.select("chunk_id").limit(3)
    asked = ids.union(ids.sparkSession.createDataFrame([("no-such-chunk\0",)], "chunk_id string"))
    got = {r[0] for r in c.get(asked).select("chunk_id").collect()}
    want = {r[0] for r in ids.collect()}
    return None if got == want else f"asked for {len(want)} known ids and got {len(got)}"


def _hits(hits: DataFrame, chunks: DataFrame, top_k: int) -> str | None:
    per = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.count_distinct("rank").alias("d"))
    if bad := _some(per.where((F.col("n") > top_k) | (F.col("a") != 1) | (F.col("b") != F.col("n")) | (F.col("d") != F.col("n"))), "query_id", "wrong number of rows or ranks for"):
        return bad
    return _some(hits.where("chunk_id is not null").join(chunks.select("chunk_id"), "chunk_id", "left_anti"), "chunk_id", "unknown ids")


def _direction(hits: DataFrame) -> str | None:
    before = F.lag("score").over(Window.partitionBy("query_id").orderBy("rank"))
    return _some(hits.withColumn("before", before).where(F.col("score") > F.col("before")), "query_id", "scores rise down the ranks of")


def _filter(c, queries: DataFrame, chunks: DataFrame, top_k: int) -> str | None:
    if unknown := c.filter_operators - filters.OPERATORS:
        return f"undefined operators {sorted(unknown)}"
    if "$eq" not in c.filter_operators:
        return None
    doc = chunks.select("doc_id").first()[0]
    outside = c.query(queries, top_k, {"doc_id": doc}).join(chunks.where(F.col("doc_id") != doc).select("chunk_id"), "chunk_id", "left_semi")
    return _some(outside, "chunk_id", "rows outside of the filter:")


def _vectors(c, chunks: DataFrame) -> str | None:
    v = c.vectors()
    if bad := _some(v.join(chunks.select("chunk_id"), "chunk_id", "left_anti"), "chunk_id", "vectors of unknown chunks"):
        return bad
    sizes = v.select(F.size("embedding").alias("n")).distinct().limit(3).collect()
    return f"vectors of several sizes {sorted(r[0] for r in sizes)}" if len(sizes) > 1 else None
