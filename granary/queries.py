"""Queries over the project's tables, for the operators of the library's core, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import schema
from granary.functions import hashing
from granary.functions import text as tx
from granary.operators import audit, book, chunker, copies, filters, ordered, retrieval
from granary.operators import diff as table_diff
from granary.operators.search import SearchIndex, build, index_rows
from granary.session import materialize, read, shared_dir

CHUNK_FIELDS = ["doc_id", "source_file", "doc_chunk_index", "char_start", "char_end", "content_module_id", "text", "metadata"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "chunks")


def _backend(spark: SparkSession, folder: str) -> DataFrame:
    """The live copy as it stands: the latest version of each chunk."""
    rows = read(spark, folder, "backend_chunks")
    names = [c for c in rows.columns if c != "received_at"]
    return rows.groupBy("chunk_id").agg(F.max_by(F.struct(*names), "received_at").alias("x")).select("x.*")


_LATEST = "b AS (SELECT * FROM backend_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY received_at DESC NULLS LAST) = 1)"


def _entries(column: str) -> str:
    pairs = f"list_transform(json_keys({column}), lambda k: k || '=' || ({column} -> ('$.\"' || k || '\"'))::VARCHAR)"
    return f"list_sort(list_filter({pairs}, lambda x: NOT starts_with(x, 'document_filepath=')))"


_PLAIN_FIELDS = [f for f in CHUNK_FIELDS if f != "metadata"]
_TESTS = ", ".join(
    [f"CASE WHEN c.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in _PLAIN_FIELDS]
    + [f"CASE WHEN {_entries('c.metadata')} IS DISTINCT FROM {_entries('b.metadata')} THEN 'metadata' END"]
)


@query(f"""
WITH {_LATEST}
SELECT coalesce(c.chunk_id, b.chunk_id) AS chunk_id, unnest(CASE WHEN b.chunk_id IS NULL THEN ['only_in_chunks'] WHEN c.chunk_id IS NULL THEN ['only_in_backend']
  ELSE list_filter([{_TESTS}], lambda x: x IS NOT NULL) END) AS difference
FROM chunks c FULL OUTER JOIN b ON c.chunk_id = b.chunk_id""")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return table_diff.diff(
        _chunks(spark, folder), read(spark, folder, "backend_chunks"), "chunk_id", CHUNK_FIELDS,
        right_version="received_at", json_fields={"metadata": ["document_filepath"]}, names=("only_in_chunks", "only_in_backend"),
    )


# Filters ------------------------------------------------------------------------------

_SHOWN = ["chunk_id", "doc_chunk_index", "resource_type", "content_module_id"]
_SHOWN_SQL = ", ".join(_SHOWN)


@query(f"SELECT {_SHOWN_SQL} FROM chunks WHERE content_module_id IS DISTINCT FROM 'mod-000' AND resource_type IS NOT DISTINCT FROM 'faq'")
def filter_ne_missing(spark, folder):
    return filters.apply(_chunks(spark, folder), {"content_module_id": {"$ne": "mod-000"}, "resource_type": "faq"}).select(*_SHOWN)


@query(f"SELECT {_SHOWN_SQL} FROM chunks WHERE resource_type IS NULL OR resource_type NOT IN ('card', 'log')")
def filter_nin_missing(spark, folder):
    return filters.apply(_chunks(spark, folder), {"resource_type": {"$nin": ["card", "log"]}}).select(*_SHOWN)


@query(f"SELECT {_SHOWN_SQL} FROM chunks WHERE content_module_id IS NULL AND char_start IS NOT NULL")
def filter_exists(spark, folder):
    return filters.apply(_chunks(spark, folder), {"content_module_id": {"$exists": False}, "char_start": {"$exists": True}}).select(*_SHOWN)


@query(f"SELECT {_SHOWN_SQL} FROM chunks WHERE doc_chunk_index >= 40 OR (doc_chunk_index < 2 AND resource_type IN ('card', 'faq'))")
def filter_range_or(spark, folder):
    either = {"$or": [{"doc_chunk_index": {"$gte": 40}}, {"$and": [{"doc_chunk_index": {"$lt": 2}}, {"resource_type": {"$in": ["card", "faq"]}}]}]}
    return filters.apply(_chunks(spark, folder), either).select(*_SHOWN)


# Identity and contract -----------------------------------------------------------------


@query(r"SELECT chunk_id, chunk_id || chr(9) || sha256(text) || chr(10) AS line FROM chunks")
def chunk_inventory_lines(spark, folder):
    return hashing.inventory_lines(_chunks(spark, folder))


@query("""
SELECT source_identity, coalesce(max(source_fingerprint), '') AS source_fingerprint, count(*) AS listed FROM sources GROUP BY source_identity""")
def source_manifest(spark, folder):
    """One row per source: a fingerprint if any row has one."""
    rows = read(spark, folder, "sources")
    return rows.groupBy("source_identity").agg(F.coalesce(F.max("source_fingerprint"), F.lit("")).alias("source_fingerprint"), F.count("*").alias("listed"))


@query("SELECT file_type, count(*) AS sources FROM (SELECT DISTINCT source_identity, file_type FROM sources) GROUP BY file_type")
def source_summary(spark, folder):
    return read(spark, folder, "sources").select("source_identity", "file_type").distinct().groupBy("file_type").agg(F.count("*").alias("sources"))


@query("""
SELECT source_identity, sha256(file_type || chr(0) || content) AS fingerprint FROM loaded_documents WHERE content IS NOT NULL""")
def source_fingerprints(spark, folder):
    docs = read(spark, folder, "loaded_documents").where("content is not null")
    return docs.select("source_identity", hashing.source_fingerprint(F.col("file_type"), F.col("content")).alias("fingerprint"))


@query("""
SELECT 'chunk_id_repeated' AS rule, sum(n - 1)::BIGINT AS violations FROM (SELECT count(*) AS n FROM backend_chunks GROUP BY chunk_id HAVING count(*) > 1) HAVING sum(n - 1) > 0""")
def contract_violations(spark, folder):
    """What the live copy breaks of the row contract: it delivers rows twice."""
    return schema.contract_violations(read(spark, folder, "backend_chunks"))


@query("""
SELECT doc_id, count(*) AS chunks, min(doc_chunk_index) AS first, max(doc_chunk_index) AS last, count(DISTINCT doc_chunk_index) AS "distinct"
FROM backend_chunks GROUP BY doc_id HAVING NOT (min(doc_chunk_index) = 0 AND max(doc_chunk_index) = count(*) - 1 AND count(DISTINCT doc_chunk_index) = count(*))""")
def dense_ordinals(spark, folder):
    return schema.undense_documents(read(spark, folder, "backend_chunks"))


# Chunking ------------------------------------------------------------------------------


@query()
def chunked_documents(spark, folder):
    return chunker.number_globally(chunker.chunk_documents(read(spark, folder, "loaded_documents"), 1000, 200))


@query("""
SELECT count(*) AS chunks, count(*) FILTER (WHERE substr(d.content, char_start + 1, char_end - char_start) = c.text) AS in_place
FROM chunks c JOIN loaded_documents d ON c.doc_id = d.source_identity WHERE char_start IS NOT NULL AND char_end IS NOT NULL""")
def chunks_in_place(spark, folder):
    docs = read(spark, folder, "loaded_documents").select(F.col("source_identity").alias("doc_id"), "content")
    both = _chunks(spark, folder).where("char_start is not null and char_end is not null").join(docs, "doc_id")
    same = F.substring("content", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")
    return both.agg(F.count("*").alias("chunks"), F.count_if(same).alias("in_place"))


# Copies --------------------------------------------------------------------------------

_BLANK_SQL = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_COLLAPSED = rf"trim(regexp_replace(text, '{_BLANK_SQL}', ' ', 'g'))"


@query(f"""
WITH g AS (SELECT chunk_id, min(chunk_id) OVER w AS rep, count(*) OVER w AS n FROM chunks WINDOW w AS (PARTITION BY {_COLLAPSED}))
SELECT 'I' || substr(sha256(rep), 1, 15) AS group_id, 'identical' AS kind, chunk_id FROM g WHERE n > 1""")
def identical_groups(spark, folder):
    return copies.identical_groups(_chunks(spark, folder))


_NEAR = r"""
WITH w AS (SELECT chunk_id, text, array_to_string(regexp_extract_all(strip_accents(lower(regexp_replace(text, '\\([!-/:-@\[-`{-~]|\n)', '\1', 'g'))), '[\p{L}\p{N}_]+'), ' ') AS w FROM chunks),
"""


@query(_NEAR + f"""g AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY w) AS rep, min({_COLLAPSED}) OVER (PARTITION BY w) AS a, max({_COLLAPSED}) OVER (PARTITION BY w) AS b FROM w WHERE w <> '')
SELECT 'N' || substr(sha256(rep), 1, 15) AS group_id, 'near' AS kind, chunk_id FROM g WHERE a <> b""")
def near_groups(spark, folder):
    return copies.near_groups(copies.near_table(_chunks(spark, folder)))


@query(_NEAR + "x AS (SELECT 1) SELECT chunk_id, CASE WHEN w = '' THEN chunk_id ELSE min(chunk_id) OVER (PARTITION BY w) END AS copy_rep FROM w")
def copy_rep(spark, folder):
    return copies.near_table(_chunks(spark, folder)).select("chunk_id", "copy_rep")


def _overlaps(width: int) -> str:
    return rf"""
WITH w AS (SELECT chunk_id, regexp_extract_all(strip_accents(lower(regexp_replace(text, '\\([!-/:-@\[-`{{-~]|\n)', '\1', 'g'))), '[\p{{L}}\p{{N}}_]+') AS w FROM chunks),
k AS (SELECT min(chunk_id) AS chunk_id, w FROM w WHERE len(w) >= 30 GROUP BY w),
s AS (SELECT chunk_id, list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) AS s FROM k),
e AS (SELECT chunk_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT chunk_a, chunk_b, shared AS shared_shingles, round(shared / least(na, nb), 4) AS containment, round(shared / greatest(na, nb), 4) AS containment_larger
FROM p WHERE shared >= 0.8 * least(na, nb)"""


@query(_overlaps(5))
def overlap_pairs(spark, folder):
    return copies.overlap_pairs(copies.near_table(_chunks(spark, folder)))


@query(_overlaps(8))
def overlap_pairs_of_eight(spark, folder):
    """The same with shingles of eight words."""
    return copies.overlap_pairs(copies.near_table(_chunks(spark, folder)), width=8)


def _least_labels(rounds: int) -> str:
    """Every node takes the least label of its neighbourhood, ``rounds`` times: complete where no component is wider than that."""
    step = "l{i} AS MATERIALIZED (SELECT node, min(root) AS root FROM (SELECT u.a AS node, l.root FROM u JOIN l{j} l ON u.b = l.node UNION ALL SELECT node, root FROM l{j}) GROUP BY node)"
    steps = ", ".join(step.format(i=i, j=i - 1) for i in range(1, rounds + 1))
    return f"""
WITH e AS (SELECT DISTINCT o_custkey AS a, l_suppkey + 10000000 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
l0 AS (SELECT DISTINCT a AS node, a AS root FROM u), {steps} SELECT node, root FROM l{rounds}"""


@query(_least_labels(8))
def connected_components(spark, folder):
    """Components of the graph of customers and suppliers, over all order lines."""
    items, orders = read(spark, folder, "lineitem"), read(spark, folder, "orders")
    edges = items.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return copies.components(edges.select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 10_000_000).alias("b")))


# Search --------------------------------------------------------------------------------

_INDEX = r"""
WITH tok AS (SELECT chunk_id, doc_id, content_module_id AS task_id, coalesce(json_extract_string(metadata, '$.source_document_name'), source_file) AS source, text,
  regexp_extract_all(lower(strip_accents(regexp_replace(text, '\\([!-/:-@\[-`{-~]|\n)', '\1', 'g'))), '[\p{L}\p{N}]+') AS w FROM chunks),
"""


_built: dict[tuple, str] = {}


def _index(spark, folder, groups: bool = False) -> SearchIndex:
    """The index of a folder's chunks: built once per application, below the shared folder, and opened by every query."""
    key = spark.sparkContext.applicationId, folder, groups
    if key not in _built:
        path = f"{shared_dir(spark)}/granary/search-{uuid.uuid4().hex}"
        build(_chunks(spark, folder), path, groups=groups)
        _built[key] = path
    return SearchIndex.open(spark, _built[key])


def _hits(result) -> DataFrame:
    return result.hits.select("chunk_id")


@query(_INDEX + "x AS (SELECT 1) SELECT chunk_id FROM tok WHERE list_contains(w, 'airlock') AND (list_contains(w, 'seal') OR list_contains(w, 'gate')) AND NOT list_contains(w, 'crew')")
def word_and_or_not(spark, folder):
    return _hits(_index(spark, folder).search(all=["airlock"], any=["seal", "gate"], not_=["crew"]))


@query(_INDEX + "x AS (SELECT 1) SELECT chunk_id FROM tok WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' coolant loop ')")
def phrase_search(spark, folder):
    return _hits(_index(spark, folder).search(phrase=["coolant loop"]))


@query(_INDEX + "x AS (SELECT 1) SELECT chunk_id FROM tok WHERE len(list_filter(w, lambda t: starts_with(t, 'recalibr'))) > 0")
def prefix_search(spark, folder):
    return _hits(_index(spark, folder).search(all=["recalibr*"]))


@query(_INDEX + """p AS (SELECT chunk_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM tok)
SELECT DISTINCT a.chunk_id FROM p a JOIN p b ON a.chunk_id = b.chunk_id AND a.t = 'tether' AND b.t = 'winch' AND abs(a.i - b.i) - 1 <= 3""")
def near_search(spark, folder):
    return _hits(_index(spark, folder).search(near=[("tether", "winch", 3)]))


@query(r"SELECT chunk_id FROM chunks WHERE contains(lower(regexp_replace(text, '\\([!-/:-@\[-`{-~]|\n)', '\1', 'g')), 'reads 2')")
def substring_search(spark, folder):
    return _hits(_index(spark, folder).search(substring=["Reads 2"]))


@query(r"SELECT chunk_id FROM chunks WHERE regexp_matches(regexp_replace(text, '\\([!-/:-@\[-`{-~]|\n)', '\1', 'g'), 'label [A-Z]{2}\d{7} must', 'i')")
def regex_search(spark, folder):
    return _hits(_index(spark, folder).search(regex=[r"label [A-Z]{2}\d{7} must"]))


@query(_INDEX + """x AS (SELECT chunk_id, task_id, doc_id, list_contains(w, 'purge') AS hit FROM tok)
SELECT doc_id, count(*) AS hits FROM x WHERE hit GROUP BY doc_id""")
def facets_by_doc(spark, folder):
    return _index(spark, folder).search(all=["purge"]).by_doc.select("doc_id", "hits")


@query(_INDEX + """x AS (SELECT chunk_id, task_id, doc_id, list_contains(w, 'purge') AS hit FROM tok)
SELECT task_id, count(*) AS hits FROM x WHERE hit GROUP BY task_id""")
def facets_by_module(spark, folder):
    return _index(spark, folder).search(all=["purge"]).by_module.select("task_id", "hits")


def _bm25(limit: str) -> str:
    return _INDEX + f"""
d AS (SELECT *, len(w) + len(regexp_extract_all(lower(strip_accents(source)), '[\\p{{L}}\\p{{N}}]+')) AS size, len(list_filter(w, lambda t: t = 'tether')) AS f1, len(list_filter(w, lambda t: t = 'winch')) AS f2 FROM tok),
g AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (WHERE f1 > 0) AS n1, count(*) FILTER (WHERE f2 > 0) AS n2 FROM d),
s AS (SELECT chunk_id, round(greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * size / mean))
  + greatest(ln((n - n2 + 0.5) / (n2 + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * size / mean)), 4) AS score FROM d, g WHERE f1 > 0 AND f2 > 0)
SELECT chunk_id, score FROM s {limit}"""


@query(_bm25(""))
def bm25_scores(spark, folder):
    return _index(spark, folder).search(all=["tether", "winch"]).hits.select("chunk_id", "score")


@query()
def search_top10(spark, folder):
    """A ranked search with heading, snippet and score: the best ten hits."""
    return _index(spark, folder).search(all=["airlock"], any=["seal", "winch"], limit=10).hits


@query("""
SELECT content_module_id AS task_id, count(*) AS chunks, count(DISTINCT doc_id) AS docs FROM chunks WHERE content_module_id IS NOT NULL GROUP BY ALL""")
def modules(spark, folder):
    return _index(spark, folder).modules()


@query("""
SELECT count(*) AS chunks, count(DISTINCT doc_id) AS docs, count(DISTINCT content_module_id) AS modules, count(*) FILTER (WHERE content_module_id IS NULL) AS general
FROM chunks WHERE resource_type = 'faq'""")
def scope_summary(spark, folder):
    return _index(spark, folder).where({"resource_type": "faq"}).scope_summary()


# Order in documents ---------------------------------------------------------------------

_WIN = "WINDOW w AS (PARTITION BY doc_id ORDER BY doc_chunk_index NULLS LAST, chunk_id)"


@query(f"""
SELECT chunk_id, coalesce(lag(chunk_id) OVER w, '') AS prev, coalesce(lead(chunk_id) OVER w, '') AS next, row_number() OVER w - 1 AS position,
  count(*) OVER (PARTITION BY doc_id) AS doc_chunks FROM chunks {_WIN}""")
def prev_next(spark, folder):
    return ordered.around(_chunks(spark, folder))


@query(rf"""
WITH h AS (SELECT chunk_id, doc_id, doc_chunk_index, list_last(regexp_extract_all(text, '(?m)^#{{1,3}}[ \t]+([^\n\r]+?)[ \t]*$', 1)) AS heading FROM chunks)
SELECT chunk_id, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY doc_chunk_index NULLS LAST, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading_before FROM h""")
def heading_carry(spark, folder):
    """The last Markdown heading of the document before each chunk."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^#{1,3}[ \t]+([^\n\r]+?)[ \t]*$"), 1)
    return ordered.carry(_chunks(spark, folder), F.try_element_at(found, F.lit(-1)), "heading_before").select("chunk_id", "heading_before")


@query()
def outline(spark, folder):
    """Every document's outline."""
    rows = index_rows(_chunks(spark, folder))
    return rows.select("doc_id", "chunk_id", "doc_chunk_index", F.col("headings.title").alias("headings"), "heading_before", F.length("plain").alias("chars"))


# Drift ---------------------------------------------------------------------------------


@query(f"""
WITH {_LATEST}, s AS (SELECT c.chunk_id AS l, b.chunk_id AS r, c.text AS tl, b.text AS tr FROM chunks c FULL OUTER JOIN b ON c.chunk_id = b.chunk_id),
lo AS (SELECT l AS id, tl AS t FROM s WHERE r IS NULL), ro AS (SELECT r AS id, tr AS t FROM s WHERE l IS NULL),
z AS (SELECT t, na, nb FROM (SELECT t, count(*) AS na FROM lo GROUP BY t) JOIN (SELECT t, count(*) AS nb FROM ro GROUP BY t) USING (t))
SELECT l AS chunk_id, r AS backend_chunk_id, CASE WHEN tl = tr THEN 'unchanged' ELSE 'text_changed' END AS status FROM s WHERE l IS NOT NULL AND r IS NOT NULL
UNION ALL SELECT lo.id, ro.id, 'id_changed' FROM lo JOIN ro USING (t) JOIN z USING (t) WHERE na = 1 AND nb = 1
UNION ALL SELECT lo.id, NULL, 'ambiguous' FROM lo JOIN z USING (t) WHERE na > 1 OR nb > 1
UNION ALL SELECT id, NULL, 'missing' FROM lo WHERE t NOT IN (SELECT t FROM z)
UNION ALL SELECT NULL, id, 'added' FROM ro WHERE t NOT IN (SELECT t FROM z)""")
def audit_status(spark, folder):
    return audit.match(_chunks(spark, folder), _backend(spark, folder)).select("chunk_id", "backend_chunk_id", "status")


_STATUS = SQL["audit_status"].replace("SELECT l AS chunk_id", ", m AS (SELECT l AS chunk_id", 1).strip() + ")"


@query(_STATUS + """
, o AS (SELECT c.doc_id, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'text_changed') AS text_changed, count(*) FILTER (WHERE status = 'id_changed') AS id_changed,
  count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) AS dataset_chunks FROM m JOIN chunks c ON c.chunk_id = m.chunk_id GROUP BY c.doc_id)
, n AS (SELECT b.doc_id, count(*) AS backend_chunks, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE m.chunk_id IS NOT NULL) AS held FROM b LEFT JOIN m ON m.backend_chunk_id = b.chunk_id GROUP BY b.doc_id)
, j AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(dataset_chunks, 0) AS dataset_chunks, coalesce(backend_chunks, 0) AS backend_chunks, coalesce(unchanged, 0) AS unchanged, coalesce(text_changed, 0) AS text_changed,
  coalesce(id_changed, 0) AS id_changed, coalesce(ambiguous, 0) AS ambiguous, coalesce(missing, 0) AS missing, coalesce(added, 0) AS added, coalesce(held, 0) AS held FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id)
SELECT doc_id, CASE WHEN dataset_chunks = 0 AND held = 0 AND added > 0 THEN 'added' WHEN dataset_chunks = 0 THEN 'changed' WHEN dataset_chunks = missing AND backend_chunks = 0 THEN 'removed'
  WHEN unchanged = dataset_chunks AND added = 0 THEN 'unchanged' ELSE 'changed' END AS status, dataset_chunks, backend_chunks, unchanged, text_changed, id_changed, ambiguous, missing, added FROM j""")
def audit_documents(spark, folder):
    a, b = _chunks(spark, folder), materialize(_backend(spark, folder), "backend")
    return audit.documents(materialize(audit.match(a, b), "matched"), a, b)


@query()
def audit_profile(spark, folder):
    return audit.profile(_chunks(spark, folder))


@query("""
WITH s AS (SELECT list_sort(list(length(text))) AS l FROM chunks), d AS (SELECT median(n) AS m FROM (SELECT count(*) AS n FROM chunks GROUP BY doc_id))
SELECT len(l) AS chunks, l[1] AS min, list_median(l)::DOUBLE AS median, l[len(l)] AS max, l[least(len(l), (0.9 * len(l))::BIGINT + CASE WHEN (0.9 * len(l))::BIGINT > 0.9 * len(l) THEN 0 ELSE 1 END)] AS p90,
  m AS chunks_per_doc_median FROM s, d""")
def audit_lengths(spark, folder):
    return audit.profile(_chunks(spark, folder)).select("chunks", "min", "median", "max", "p90", "chunks_per_doc_median")


@query("SELECT key, count(*) AS chunks FROM (SELECT unnest(json_keys(metadata)) AS key FROM chunks) WHERE key <> 'document_filepath' GROUP BY key")
def metadata_keys(spark, folder):
    return audit.metadata_keys(_chunks(spark, folder))


@query(f"""
WITH {_LATEST}, s AS (SELECT coalesce(c.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN b.chunk_id IS NULL THEN 'missing' WHEN c.chunk_id IS NULL THEN 'added'
  WHEN c.doc_id <> b.doc_id THEN 'moved_document' WHEN c.doc_chunk_index <> b.doc_chunk_index THEN 'moved_position' END AS difference
  FROM chunks c FULL OUTER JOIN b ON c.chunk_id = b.chunk_id)
SELECT * FROM s WHERE difference IS NOT NULL""")
def lite_structure(spark, folder):
    return audit.structure(_chunks(spark, folder), _backend(spark, folder))


# Book index -----------------------------------------------------------------------------


@query()
def numbered_leads(spark, folder):
    return book.numbered_leads(_chunks(spark, folder))


@query()
def book_entries(spark, folder):
    return book.BookIndex(_chunks(spark, folder)).entries


@query()
def book_locations(spark, folder):
    return book.BookIndex(_chunks(spark, folder)).locations


@query()
def book_threads(spark, folder):
    return book.BookIndex(_chunks(spark, folder)).threads


@query()
def book_lookup(spark, folder):
    return book.BookIndex(_chunks(spark, folder)).lookup("abschnitt")


# Vectors and results ---------------------------------------------------------------------


@query("""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS raw
  FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, id) AS rank, id, score FROM s QUALIFY rank <= 10""")
def vector_topk(spark, folder):
    """The ten most similar vectors for every vector whose id is divisible by 50, against all."""
    vectors = read(spark, folder, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.vector_topk(vectors, queries, 10).withColumn("score", F.round("score", 6))


def _rows(spark, folder) -> DataFrame:
    """Returned rows made of events: one result per user, some rows context, some unscored."""
    from pyspark.sql.window import Window

    e = read(spark, folder, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    role = F.when(F.col("event_type") == "view", "context").otherwise("match")
    return e.select(
        F.col("user_id").alias("query_id"), place.alias("rank"), F.concat(F.lit("c"), F.col("event_id") % 97).alias("chunk_id"), F.col("event_id").cast("string").alias("text"),
        F.when(role == "match", F.col("value")).alias("score"), role.alias("role"), F.when(role == "context", "neighbour").alias("origin"), (F.col("event_id") % 7).cast("int").alias("k"),
    )


_ROWS = """
WITH rows AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, 'c' || (event_id % 97) AS chunk_id, event_id::VARCHAR AS text,
  CASE WHEN event_type <> 'view' THEN value END AS score, CASE WHEN event_type = 'view' THEN 'context' ELSE 'match' END AS role FROM events)
"""


@query(_ROWS + """, f AS (SELECT query_id, chunk_id, rank, score, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, rank) AS k FROM rows WHERE role = 'match')
, m AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY score DESC, rank) AS ranked FROM f WHERE k = 1 GROUP BY query_id)
, c AS (SELECT query_id, count(*) FILTER (WHERE role = 'context') AS context_rows, count(*) FILTER (WHERE role = 'match' AND score IS NULL) AS unscored_match_rows, count(*) FILTER (WHERE role = 'match') AS n FROM rows GROUP BY query_id)
SELECT query_id, CASE WHEN n = 0 THEN 'not_applicable' WHEN unscored_match_rows > 0 THEN 'error' ELSE 'scores' END AS status,
  CASE WHEN n > 0 AND unscored_match_rows = 0 THEN ranked ELSE '' END AS ranked, context_rows, unscored_match_rows FROM c LEFT JOIN m USING (query_id)""")
def ranking_basis(spark, folder):
    basis = retrieval.ranking_basis(_rows(spark, folder), "scored")
    return basis.select("query_id", "status", F.array_join("ranked_ids", ",").alias("ranked"), "context_rows", "unscored_match_rows")


@query(_ROWS + """, i AS (SELECT *, text::BIGINT % 7 AS k FROM rows), g AS (SELECT query_id, k, max(CASE WHEN role = 'match' THEN score END) AS score, min(rank) AS first, count(*) AS n FROM i GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS item_rank, score, n AS rows FROM g""")
def read_items(spark, folder):
    rows = _rows(spark, folder).select(
        "query_id", "rank", "chunk_id", "score", F.col("k").alias("item_index"), F.lit("passage").alias("item_kind"), F.lit(None).cast("array<string>").alias("item_covered_ids"),
        F.col("role").alias("item_role"), F.col("origin").alias("item_origin"),
    )
    return retrieval.items(rows).select("query_id", "item_rank", "score", F.size("row_ranks").cast("long").alias("rows"))


@query(_ROWS + "SELECT query_id, string_agg('[' || rank || '] chunk_id=' || chunk_id || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS block FROM rows GROUP BY query_id")
def rag_block(spark, folder):
    return retrieval.rag_blocks(_rows(spark, folder))


# Free SQL over the star tables ------------------------------------------------------------


def _sql(name: str, statement: str, duck: str | None = None) -> None:
    def run(spark, folder):
        from granary.plans.sql_surface import SqlSurface

        tables = "region nation customer supplier part orders lineitem events".split()
        return SqlSurface(spark, {t: read(spark, folder, t) for t in tables}).frame(statement)

    QUERIES[name], SQL[name] = run, duck or statement


_sql("sql_join_aggregate", """
SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name HAVING count(*) > 1""")
_sql("sql_window", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders""")
_sql("sql_set_operations", """
SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)""")
_sql("sql_cte_subqueries", """
WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, (SELECT top FROM big WHERE o_custkey = c_custkey) AS top FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < 1000)""")
_sql("sql_outer_join", """
SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
_sql("sql_grouping_sets", """
SELECT l_returnflag, l_linestatus, count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
_sql("sql_case_like_null", """
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' WHEN p_size > 10 THEN 'medium' ELSE 'small' END AS size_class, coalesce(nullif(p_brand, 'Brand#11'), 'other') AS brand
FROM part WHERE p_name LIKE '%a%'""")
_sql("sql_json", """
SELECT event_type, count(get_json_object(props, '$.k')) AS keyed, count(*) AS n FROM events GROUP BY event_type""",
     "SELECT event_type, count(json_extract_string(props, '$.k')) AS keyed, count(*) AS n FROM events GROUP BY event_type")
_PRICING = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= {} '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""
_sql("sql_pricing_summary", _PRICING.format("timestamp_ntz"), _PRICING.format("timestamp"))


@query(rf"SELECT chunk_id, trim(regexp_replace(regexp_replace(text, '\\([!-/:-@\[-`{{-~]|\n)', '\1', 'g'), '{_BLANK_SQL}', ' ', 'g')) AS plain FROM chunks")
def plain_texts(spark, folder):
    return _chunks(spark, folder).select("chunk_id", tx.collapsed(tx.plain(F.col("text"))).alias("plain"))


# The rest is registered on import.
from granary import more_queries as _more  # noqa: E402, F401
