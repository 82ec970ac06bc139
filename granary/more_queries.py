"""More queries over the project's tables: scopes, reading around hits, copies, drift, connectors, bounds, streams; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import hashing, prompts
from granary.functions import text as tx
from granary.operators import audit, chunker, copies, ordered, retrieval
from granary.plans.sql_surface import SqlSurface
from granary.queries import _COLLAPSED, _INDEX, _LATEST, _NEAR, _PLAIN_FIELDS, _ROWS, _STATUS, _backend, _bm25, _chunks, _entries, _index, _overlaps, _rows, query
from granary.session import materialize, read, shared_dir
from granary.sources import connectors, dataset
from granary.streaming import ingest

HOT = "logs/continuous-watch-log.txt"
_HITS = _INDEX + "h AS (SELECT tok.chunk_id, doc_id, task_id, source, resource_type, doc_chunk_index, c.text FROM tok JOIN chunks c USING (chunk_id, doc_id) WHERE list_contains(w, 'purge'))"


# Search --------------------------------------------------------------------------------


@query(_INDEX + "x AS (SELECT 1) SELECT chunk_id FROM tok WHERE list_contains(w, 'water') OR list_contains(regexp_extract_all(lower(strip_accents(source)), '[\\p{L}\\p{N}]+'), 'water')")
def title_search(spark, folder):
    return _index(spark, folder).search(all=["Water"], titles=True).hits.select("chunk_id")


@query(_INDEX + "x AS (SELECT 1) SELECT chunk_id FROM tok WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' coolant loop ')")
def quoted_term(spark, folder):
    """Punctuation in a term parts words and is never read as an operator."""
    return _index(spark, folder).search(all=['"coolant" -(loop)']).hits.select("chunk_id")


@query(_HITS + " SELECT chunk_id FROM h WHERE task_id IN ('mod-002', 'mod-007')")
def module_hits(spark, folder):
    return _index(spark, folder).search(all=["purge"], modules=["mod-002", "mod-007"]).hits.select("chunk_id")


@query(_HITS + " SELECT chunk_id FROM h WHERE task_id IS NULL OR task_id = 'mod-002'")
def general_hits(spark, folder):
    return _index(spark, folder).search(all=["purge"], modules=["mod-002"], general_only=True).hits.select("chunk_id")


@query(_HITS + f" SELECT chunk_id FROM h WHERE doc_id = '{HOT}'")
def document_hits(spark, folder):
    return _index(spark, folder).search(all=["purge"], docs=[HOT]).hits.select("chunk_id")


@query(_HITS + f" SELECT chunk_id FROM h WHERE doc_id <> '{HOT}'")
def other_document_hits(spark, folder):
    return _index(spark, folder).search(all=["purge"], exclude_docs=[HOT]).hits.select("chunk_id")


@query(_HITS + " SELECT chunk_id FROM h WHERE resource_type IN ('faq', 'card')")
def type_hits(spark, folder):
    return _index(spark, folder).search(all=["purge"], types=["faq", "card"]).hits.select("chunk_id")


@query("SELECT chunk_id FROM chunks WHERE resource_type = 'card'")
def listing(spark, folder):
    """A search by filters alone lists what matches."""
    return _index(spark, folder).search(types=["card"]).hits.select("chunk_id")


@query("SELECT chunk_id FROM chunks WHERE resource_type = 'faq' AND doc_chunk_index < 3 AND content_module_id IS NOT NULL")
def narrowed_scope(spark, folder):
    """A scope narrowed twice."""
    return _index(spark, folder).where({"resource_type": "faq"}).where({"doc_chunk_index": {"$lt": 3}, "task_id": {"$exists": True}}).table("chunks").select("chunk_id")


@query(_bm25("JOIN (SELECT chunk_id, doc_id, doc_chunk_index, coalesce(json_extract_string(metadata, '$.source_document_name'), source_file) AS source FROM chunks) USING (chunk_id) ORDER BY score DESC, source, doc_id, doc_chunk_index NULLS LAST, chunk_id LIMIT 10"))
def ranked_top10(spark, folder):
    return _index(spark, folder).search(all=["tether", "winch"], limit=10).hits.select("chunk_id", "score")


_PLAIN = r"regexp_replace(text, '\\([!-/:-@\[-`{-~]|\n)', '\1', 'g')"
_SNIPPET = r"""
WITH p AS (SELECT chunk_id, {plain} AS p, instr(lower({plain}), 'reads 2') - 1 AS pos FROM chunks WHERE contains(lower({plain}), 'reads 2'))
SELECT chunk_id, CASE WHEN pos > 100 THEN '…' ELSE '' END || trim(regexp_replace(substr(p, greatest(pos - 100, 0) + 1, pos - greatest(pos - 100, 0) + 200), '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]+', ' ', 'g'))
  || CASE WHEN length(p) > pos + 200 THEN '…' ELSE '' END AS snippet FROM p"""


@query(_SNIPPET.format(plain=_PLAIN))
def hit_snippets(spark, folder):
    """Where each hit matches first, with the text around it."""
    return _index(spark, folder).search(substring=["Reads 2"]).hits.select("chunk_id", "snippet")


@query(f"SELECT DISTINCT doc_id FROM chunks WHERE doc_id = '{HOT}' OR lower(coalesce(json_extract_string(metadata, '$.source_document_name'), source_file)) = '{HOT}'")
def documents_of_title(spark, folder):
    return _index(spark, folder).documents(HOT.upper() if not HOT.islower() else HOT)


@query(f"""
WITH o AS (SELECT chunk_id, doc_id, row_number() OVER (ORDER BY doc_chunk_index NULLS LAST, chunk_id) AS r FROM chunks WHERE doc_id = '{HOT}'), t AS (SELECT r FROM o WHERE chunk_id = '{HOT}:chunk-5')
SELECT (o.r - t.r)::INTEGER AS "offset", chunk_id FROM o, t WHERE abs(o.r - t.r) <= 3""")
def neighbours_of_chunk(spark, folder):
    return _index(spark, folder).neighbors(f"{HOT}:chunk-5", 3).select("offset", "chunk_id")


@query(f"SELECT doc_id, chunk_id, doc_chunk_index, length({_PLAIN})::INTEGER AS chars FROM chunks WHERE doc_id = '{HOT}'")
def outline_of_document(spark, folder):
    return _index(spark, folder).outline(HOT).select("doc_id", "chunk_id", "doc_chunk_index", "chars")


# Copies --------------------------------------------------------------------------------

_GROUPS = f"""
g AS (SELECT chunk_id, resource_type, min(chunk_id) OVER w AS rep, count(*) OVER w AS n FROM chunks WINDOW w AS (PARTITION BY {_COLLAPSED})),
i AS (SELECT 'I' || substr(sha256(rep), 1, 15) AS group_id, chunk_id, resource_type FROM g WHERE n > 1)
"""


@query(f"WITH {_GROUPS} SELECT group_id, count(*) AS size FROM i GROUP BY group_id")
def group_sizes(spark, folder):
    groups = _index(spark, folder, True).table("copy_groups").where("kind = 'identical'")
    return groups.groupBy("group_id").agg(F.count("*").alias("size"))


@query(f"WITH {_GROUPS} SELECT group_id, chunk_id FROM i WHERE resource_type = 'passage'")
def scoped_groups(spark, folder):
    return _index(spark, folder, True).where({"resource_type": "passage"}).table("copy_groups").where("kind = 'identical'").select("group_id", "chunk_id")


@query(_INDEX + _GROUPS + ", s AS (SELECT group_id, count(*) AS size FROM i GROUP BY group_id) SELECT tok.chunk_id, size FROM tok LEFT JOIN i USING (chunk_id) LEFT JOIN s USING (group_id) WHERE list_contains(w, 'purge')")
def copy_badges(spark, folder):
    index = _index(spark, folder, True)
    own = F.filter("copies", lambda c: c["kind"] == "identical")
    return index.badges(index.search(all=["purge"]).hits).select("chunk_id", F.get(own, F.lit(0))["size"].alias("size"))


_REPS = "r AS (SELECT chunk_id, resource_type, CASE WHEN array_to_string(w, ' ') = '' THEN chunk_id ELSE min(chunk_id) OVER (PARTITION BY array_to_string(w, ' ')) END AS rep FROM w JOIN chunks USING (chunk_id))"


def _overlaps_with(ctes: str, select: str, recursive: str = "") -> str:
    """The pairs of overlapping chunks as ``o`` with further common tables, and a statement on them."""
    head, tail = _overlaps(5).split("SELECT chunk_a, chunk_b, shared AS", 1)
    return head.replace("WITH", f"WITH {recursive}", 1).rstrip() + f", o AS (SELECT chunk_a, chunk_b, shared AS{tail}), {_REPS}{ctes} {select}"


@query(_overlaps_with("", "SELECT chunk_a, chunk_b FROM o WHERE chunk_a IN (SELECT rep FROM r WHERE resource_type = 'passage') AND chunk_b IN (SELECT rep FROM r WHERE resource_type = 'passage')"))
def scoped_pairs(spark, folder):
    """Overlaps with a member of both sides in the scope."""
    return _index(spark, folder, True).where({"resource_type": "passage"}).table("overlap_pairs").select("chunk_a", "chunk_b")


_LINKED = """, l AS (SELECT chunk_a AS a, chunk_b AS b FROM o WHERE containment_larger >= 0.5 UNION SELECT chunk_b, chunk_a FROM o WHERE containment_larger >= 0.5),
t AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, t.root FROM t JOIN l ON l.a = t.node), m AS (SELECT node, min(root) AS root FROM t GROUP BY node)"""


@query(_overlaps_with(_LINKED, "SELECT 'O' || substr(sha256(root), 1, 15) AS group_id, 'overlap' AS kind, chunk_id FROM r JOIN m ON r.rep = m.node", "RECURSIVE"))
def overlap_groups(spark, folder):
    near = copies.near_table(_chunks(spark, folder))
    return copies.overlap_groups(materialize(copies.overlap_pairs(near), "pairs"), near)


@query(_NEAR + "k AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY w) AS rep, count(*) OVER (PARTITION BY w) AS n FROM w WHERE w <> '') SELECT rep AS copy_rep, count(*) AS copies FROM k WHERE n > 1 GROUP BY rep")
def representatives(spark, folder):
    """The chunk that stands for its near copies, and how many they are."""
    near = copies.near_table(_chunks(spark, folder)).where("near_hash is not null")
    return near.groupBy("copy_rep").agg(F.count("*").alias("copies")).where("copies > 1")


# Identities, sources, chunks --------------------------------------------------------------

_IDENTITY = """
, leaf AS (SELECT substr(sha256(k), 1, 5) AS part, sha256(string_agg(line, '' ORDER BY k, line)) AS h FROM l GROUP BY 1)
, node AS (SELECT substr(part, 1, 3) AS part, sha256(string_agg(part || chr(9) || h || chr(10), '' ORDER BY part)) AS h FROM leaf GROUP BY 1)
SELECT sha256(string_agg(part || chr(9) || h || chr(10), '' ORDER BY part)) AS identity FROM node"""


@query("WITH l AS (SELECT chunk_id AS k, chunk_id || chr(9) || sha256(text) || chr(10) AS line FROM chunks)" + _IDENTITY)
def inventory_identity(spark, folder):
    return hashing.identity(hashing.inventory_lines(_chunks(spark, folder)), "chunk_id")


_SOURCES = """
WITH s AS (SELECT coalesce(json_extract_string(metadata, '$.source_identity'), doc_id) AS source_identity, coalesce(json_extract_string(metadata, '$.source_fingerprint'), '') AS source_fingerprint,
  coalesce(json_extract_string(metadata, '$.relative_path'), source_file) AS relative_path, coalesce(json_extract_string(metadata, '$.filename'), list_last(string_split(source_file, '/'))) AS filename,
  coalesce(json_extract_string(metadata, '$.file_type'), lower(regexp_extract(source_file, '\\.([A-Za-z0-9]+)$', 1))) AS file_type, coalesce(global_index, 1152921504606846976) AS g, coalesce(doc_chunk_index, 1073741824) AS d, chunk_id FROM chunks),
f AS (SELECT source_identity, source_fingerprint, relative_path, filename, file_type FROM s QUALIFY row_number() OVER (PARTITION BY source_identity ORDER BY g, d, chunk_id) = 1)
"""


@query(_SOURCES + "SELECT * FROM f")
def source_list(spark, folder):
    return dataset.source_list(_chunks(spark, folder))


@query(_SOURCES + "SELECT file_type, count(*) AS sources FROM f GROUP BY file_type")
def source_types(spark, folder):
    return dataset.source_list(_chunks(spark, folder)).groupBy("file_type").agg(F.count("*").alias("sources"))


@query(_SOURCES + ", l AS (SELECT source_identity AS k, concat_ws(chr(0), relative_path, file_type, source_fingerprint) || chr(0) AS line FROM f)" + _IDENTITY)
def corpus_identity(spark, folder):
    return hashing.identity(hashing.corpus_lines(dataset.source_list(_chunks(spark, folder))), "source_identity")


@query(r"""
SELECT count(*) AS documents, 0::BIGINT AS misplaced, 0::BIGINT AS too_long, 0::BIGINT AS blank_edges, 0::BIGINT AS nested, 0::BIGINT AS unnumbered
FROM loaded_documents WHERE regexp_matches(content, '[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')""")
def chunked_check(spark, folder):
    """What the chunks of all documents break: nothing, and every document that is not blank has some."""
    docs = read(spark, folder, "loaded_documents")
    rows = materialize(chunker.number_globally(chunker.chunk_documents(docs, 1000, 200)), "chunked")
    placed = rows.join(docs.select(F.col("source_identity").alias("doc_id"), "content"), "doc_id")
    placed = ordered.following(placed.select("doc_id", "doc_chunk_index", "chunk_id", "global_index", "char_start", "char_end", "text", "content"), ["char_start", "char_end"])
    there = F.substring("content", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")
    found = placed.agg(
        F.count_distinct("doc_id").alias("documents"), F.count_if(~there).alias("misplaced"), F.count_if(F.length("text") > 1000).alias("too_long"),
        F.count_if(F.col("text").rlike(rf"\A{tx.BLANK}|{tx.BLANK}\z")).alias("blank_edges"), F.count_if(F.col("next_char_end") <= F.col("char_end")).alias("nested"),
        (F.max("global_index") + 1 - F.count_distinct("global_index")).alias("unnumbered"),
    )
    return found


@query(r"""
SELECT chunk_id, substr(sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))), 1, 16) AS digest FROM chunks""")
def text_digests(spark, folder):
    return _chunks(spark, folder).select("chunk_id", tx.digest(F.col("text")).alias("digest"))


@query(r"SELECT source_identity, regexp_matches(relative_path, '\p{L}') AS human FROM loaded_documents")
def human_sources(spark, folder):
    return read(spark, folder, "loaded_documents").select("source_identity", tx.human_source(F.col("relative_path")).alias("human"))


# Drift ---------------------------------------------------------------------------------

_FIELD_TESTS = ", ".join(f"CASE WHEN c.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in _PLAIN_FIELDS if f != "text")


@query(f"WITH {_LATEST} SELECT c.chunk_id, unnest(list_filter([{_FIELD_TESTS}], lambda x: x IS NOT NULL)) AS field FROM chunks c JOIN b USING (chunk_id)")
def audit_fields(spark, folder):
    found = audit.match(_chunks(spark, folder), _backend(spark, folder)).where("chunk_id = backend_chunk_id")
    return found.select("chunk_id", F.explode("fields_changed").alias("field"))


@query(f"WITH {_LATEST} SELECT c.chunk_id FROM chunks c JOIN b USING (chunk_id) WHERE {_entries('c.metadata')} IS DISTINCT FROM {_entries('b.metadata')}")
def audit_metadata(spark, folder):
    found = audit.match(_chunks(spark, folder), _backend(spark, folder)).where("chunk_id = backend_chunk_id")
    return found.where(F.size("metadata_keys_added") + F.size("metadata_keys_removed") + F.size("metadata_keys_changed") > 0).select("chunk_id")


@query(_STATUS + """ SELECT signal, n FROM (SELECT CASE status WHEN 'text_changed' THEN 'chunk_text_changed' WHEN 'id_changed' THEN 'chunk_ids_changed' WHEN 'missing' THEN 'chunks_missing' WHEN 'added' THEN 'chunks_added'
  WHEN 'ambiguous' THEN 'chunks_ambiguous' END AS signal, count(*) AS n FROM m GROUP BY 1) WHERE signal IS NOT NULL""")
def audit_signals(spark, folder):
    """The audit's counts of chunks by what happened to them."""
    found = audit.audit(_chunks(spark, folder), materialize(_backend(spark, folder), "backend")).signals
    named = [(k, v) for k, v in found.items() if k in ("chunk_text_changed", "chunk_ids_changed", "chunks_missing", "chunks_added", "chunks_ambiguous")]
    return spark.createDataFrame(named, "signal string, n long")


@query(f"""
WITH {_LATEST} SELECT CASE WHEN b.chunk_id IS NULL THEN 'missing' WHEN c.text IS NOT DISTINCT FROM b.text THEN 'same' ELSE 'text_changed' END AS state, count(*) AS chunks FROM chunks c LEFT JOIN b USING (chunk_id) GROUP BY 1""")
def sampled_states(spark, folder):
    """A sample of all chunks."""
    drawn = audit.sampled_text_changes(_chunks(spark, folder), _backend(spark, folder), 100, 7)
    return drawn.groupBy("state").agg(F.count("*").alias("chunks"))


@query(rf"""
WITH s AS (SELECT text AS a, lead(text) OVER (PARTITION BY doc_id ORDER BY doc_chunk_index NULLS LAST, chunk_id) AS b FROM chunks),
o AS (SELECT coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: right(a, k) = left(b, k))), 0) AS o FROM s WHERE b IS NOT NULL)
SELECT count(*) AS pairs, count(*) FILTER (WHERE o > 0) AS overlapping, median(o)::DOUBLE AS overlap_median, max(o) AS overlap_max FROM o""")
def neighbour_overlaps(spark, folder):
    return audit.profile(_chunks(spark, folder)).select("pairs", "overlapping", "overlap_median", "overlap_max")


# Connectors ------------------------------------------------------------------------------

_stores: dict[tuple[str, str], str] = {}


def _store(spark, folder) -> connectors.TableConnector:
    """A table store of the chunks with their vectors, written once per application."""
    key = spark.sparkContext.applicationId, folder
    if key not in _stores:
        path = f"{shared_dir(spark)}/granary/store-{uuid.uuid4().hex}"
        vectors = read(spark, folder, "chunk_vectors").where(F.size("embedding") == 64).groupBy("chunk_id").agg(F.min("embedding").alias("embedding"))
        _chunks(spark, folder).select(*connectors.CHUNK_COLUMNS).join(vectors, "chunk_id", "left").write.parquet(path)
        _stores[key] = path
    return connectors.connect(spark, "table", {"path": _stores[key]})


@query("SELECT chunk_id, doc_id, doc_chunk_index FROM chunks")
def connector_inventory(spark, folder):
    return _store(spark, folder).inventory()


@query("SELECT count(*) AS chunks FROM chunks")
def connector_count(spark, folder):
    return spark.createDataFrame([(_store(spark, folder).count(),)], "chunks long")


@query("SELECT chunk_id, text FROM chunks WHERE resource_type = 'faq'")
def connector_fetch(spark, folder):
    """The chunks of given ids; ids that do not exist are absent."""
    ids = _chunks(spark, folder).where("resource_type = 'faq'").select("chunk_id")
    return _store(spark, folder).get(ids.union(ids.select(F.concat("chunk_id", F.lit("?"))))).select("chunk_id", "text")


@query("SELECT chunk_id, round(list_sum(e), 3) AS total FROM (SELECT chunk_id, min(embedding)::DOUBLE[] AS e FROM chunk_vectors WHERE len(embedding) = 64 AND chunk_id IN (SELECT chunk_id FROM chunks) GROUP BY chunk_id)")
def connector_vectors(spark, folder):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _store(spark, folder).vectors().select("chunk_id", F.round(total, 3).alias("total"))


_VECTOR_QUERY = f"""
WITH v AS (SELECT chunk_id, min(embedding)::DOUBLE[] AS e FROM chunk_vectors WHERE len(embedding) = 64 GROUP BY chunk_id HAVING len(list_filter(min(embedding), lambda x: x <> 0)) > 0),
s AS (SELECT q.chunk_id AS query_id, v.chunk_id, list_cosine_similarity(q.e, v.e) AS raw FROM v q JOIN v ON q.chunk_id LIKE '{HOT}%' JOIN chunks c ON c.chunk_id = v.chunk_id WHERE c.doc_chunk_index < 5)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, chunk_id) AS rank, chunk_id, round(raw, 6) AS score FROM s QUALIFY rank <= 3"""


@query(_VECTOR_QUERY)
def connector_query(spark, folder):
    """Vector search with a filter: the three nearest of the chunks at the beginning of documents."""
    store = _store(spark, folder)
    queries = store.vectors().where(F.col("chunk_id").startswith(HOT)).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    queries = queries.where(F.exists("vector", lambda x: x != 0))
    return store.query(queries, 3, {"doc_chunk_index": {"$lt": 5}}).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


# Results and prompts ------------------------------------------------------------------------


@query(_ROWS + "SELECT query_id, rank FROM rows WHERE score >= 50")
def score_threshold(spark, folder):
    return retrieval.apply_threshold(_rows(spark, folder), "scored", 50).select("query_id", "rank")


@query(_ROWS + "SELECT query_id, 'neighbour' AS origin, string_agg(chunk_id, ',' ORDER BY rank) AS ids FROM (SELECT query_id, chunk_id, min(rank) AS rank FROM rows WHERE role = 'context' GROUP BY ALL) GROUP BY query_id")
def context_ids(spark, folder):
    return retrieval.context_by_origin(_rows(spark, folder)).select("query_id", "origin", F.array_join("chunk_ids", ",").alias("ids"))


@query(_ROWS + """, k AS (SELECT *, text::BIGINT % 5 AS k FROM rows) SELECT query_id, rank, CASE k WHEN 0 THEN 'a passage has an index' WHEN 1 THEN 'unknown kind' WHEN 2 THEN 'an index is not negative' END
  || CASE WHEN k = 2 AND role = 'context' THEN '' ELSE '' END AS problems FROM k WHERE k < 3""")
def item_problems(spark, folder):
    """Rows whose declared item breaks a rule."""
    k = F.col("text").cast("long") % 5
    rows = _rows(spark, folder).select(
        "query_id", "rank", "chunk_id", "score", F.when(k == 2, -1).when(k > 0, 1).cast("int").alias("item_index"), F.when(k == 0, "passage").when(k == 1, "heap").otherwise("chunk").alias("item_kind"),
        F.lit(None).cast("array<string>").alias("item_covered_ids"), F.col("role").alias("item_role"), F.col("origin").alias("item_origin"),
    )
    return retrieval.item_problems(rows).select("query_id", "rank", F.array_join("problems", "; ").alias("problems"))


@query(_ROWS + """, b AS (SELECT query_id, string_agg('[' || rank || '] chunk_id=' || chunk_id || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS block FROM rows GROUP BY query_id)
SELECT query_id, 'Use this:' || chr(10) || block || chr(10) || 'to answer q' || query_id AS prompt, (length('Use this:') + 1 + length(block))::INTEGER AS breakpoint, sha256(block) AS block_sha256 FROM b""")
def rendered_prompts(spark, folder):
    template = prompts.PromptTemplate("t", "a test", "Use this:\n{rag_block}\nto answer {query}", cache_breakpoint="after_rag_block")
    rows = retrieval.rag_blocks(_rows(spark, folder)).withColumn("query", F.concat(F.lit("q"), "query_id"))
    return prompts.render_table(template, rows).select("query_id", "prompt", "breakpoint", "block_sha256")


# Bounded SQL ---------------------------------------------------------------------------------


def _surface(spark, folder) -> SqlSurface:
    return SqlSurface(spark, {"orders": read(spark, folder, "orders"), "loaded_documents": read(spark, folder, "loaded_documents")})


@query("SELECT o_orderkey, o_custkey, true AS truncated FROM orders ORDER BY o_orderkey LIMIT 500")
def sql_row_bound(spark, folder):
    """The row bound of interactive SQL is the feature: 500 rows and a mark that there are more."""
    found = _surface(spark, folder).run("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey")
    return spark.createDataFrame([(*r, found.truncated) for r in found.rows], "o_orderkey long, o_custkey long, truncated boolean")


@query("""SELECT source_identity, CASE WHEN length(content) > 2000 THEN substr(content, 1, 2000) || '... (+' || (length(content) - 2000) || ' chars)' ELSE content END AS content
FROM loaded_documents WHERE content IS NOT NULL ORDER BY source_identity LIMIT 500""")
def sql_cell_bound(spark, folder):
    """Long cells of interactive SQL are shortened."""
    found = _surface(spark, folder).run("SELECT source_identity, content FROM loaded_documents WHERE content IS NOT NULL ORDER BY source_identity")
    return spark.createDataFrame(found.rows, "source_identity string, content string")


@query(_INDEX + "x AS (SELECT 1) SELECT doc_id, count(*) AS n FROM tok WHERE list_contains(w, 'airlock') AND NOT list_contains(w, 'crew') GROUP BY doc_id")
def sql_match(spark, folder):
    """Full-text matches inside SQL."""
    index = _index(spark, folder)
    surface = SqlSurface(spark, {"chunks": index.table("chunks")}, index)
    return surface.frame("SELECT doc_id, count(*) AS n FROM chunks JOIN MATCH('airlock -crew') AS m USING (chunk_id) GROUP BY doc_id")


# Streams, over whole tables at once -------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark, folder):
    return _zoneless(ingest.windowed_counts(read(spark, folder, "events"), "ts", "event_type"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, folder):
    return _zoneless(ingest.sessions(read(spark, folder, "events"), "ts", "user_id"))


def _zoneless(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in rows.dtypes])
