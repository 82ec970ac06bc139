"""Queries of this subpackage over the project's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import layout_copies, mixing, neighbours, packing, personal_data, splitting, term_counts
from granary.session import read

#: The key of the queries over invented test data. Real data need a secret of their own.
TEST_KEY = "key of the test tables"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return layout_copies.found_copies(read(spark, folder, "chunks"))


def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    return layout_copies.kept_records(read(spark, folder, "chunks"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized_findings(read(spark, folder, "loaded_documents"), read(spark, folder, "split_limits"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(read(spark, folder, "loaded_documents"), read(spark, folder, "split_limits"))


def p3_check(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces break: nothing, and they reach the end of every text."""
    pieces = splitting.split_oversized(read(spark, folder, "loaded_documents"), read(spark, folder, "split_limits"))
    return splitting.check(pieces).drop("pieces")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    terms = term_counts.marked_terms(read(spark, folder, "chunks"))
    return terms.select(F.col("gram").alias("term"), F.explode("mark").alias("mark"))


def p4_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = term_counts.marked_terms(read(spark, folder, "chunks"))
    return terms.select(F.col("gram").alias("term"), "occurrences", "records", F.array_join("mark", ",").alias("mark"))


def p4_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Every sequence of two words, with its occurrences and documents."""
    grams = term_counts.ngram_counts(read(spark, folder, "chunks"), sizes=(2,))
    return grams.select(F.col("gram").alias("phrase"), "occurrences", "records")


def p4_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every sequence of twelve words that occurs more than once, with its occurrences and documents."""
    grams = term_counts.ngram_counts(read(spark, folder, "chunks"), sizes=(12,))
    return grams.where("occurrences > 1").select(F.col("gram").alias("passage"), "occurrences", "records")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.mutual_pairs(neighbours.nearest(read(spark, folder, "chunk_vectors")), 0.90)


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.nearest(read(spark, folder, "chunk_vectors"))
    return near.select(F.col("id").alias("chunk_id"), "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


def p5_check(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable vector has five different neighbours, and their similarities are exact."""
    vectors = read(spark, folder, "chunk_vectors")
    return neighbours.check(neighbours.nearest(vectors), vectors)


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), read(spark, folder, "pack_capacities"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    capacities = read(spark, folder, "pack_capacities")
    return packing.fill_report(packing.pack(read(spark, folder, "documents"), capacities), capacities)


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """What the packing breaks: nothing, and every document is in it."""
    capacities = read(spark, folder, "pack_capacities")
    return packing.check(packing.pack(read(spark, folder, "documents"), capacities), capacities)


def p7_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.ordered_mix(mixing.mix(mixing.queue(read(spark, folder, "documents")), read(spark, folder, "mix_targets"), budget="sources"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = read(spark, folder, "mix_targets")
    return mixing.shares(mixing.mix(mixing.queue(read(spark, folder, "documents")), targets, budget="sources"), targets)


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """What the mixes break: nothing."""
    queued, targets = mixing.queue(read(spark, folder, "documents")), read(spark, folder, "mix_targets")
    return mixing.check(mixing.mix(queued, targets, budget="sources"), queued, targets)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.found_mentions(read(spark, folder, "documents"), read(spark, folder, "name_list"))


def p8_replaced(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.replace(read(spark, folder, "documents"), read(spark, folder, "name_list"), TEST_KEY)


def p8_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.replace(read(spark, folder, "documents"), read(spark, folder, "name_list"), TEST_KEY, style="surrogate")


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """What the surrogates break: no mention stays, no two entities are written alike, nothing else changes."""
    docs, names = read(spark, folder, "documents"), read(spark, folder, "name_list")
    return personal_data.check(docs, personal_data.replace(docs, names, TEST_KEY, style="surrogate"), names)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_kept": p1_kept,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_check": p3_check,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p4_phrases": p4_phrases,
    "p4_passages": p4_passages,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p5_check": p5_check,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p6_check": p6_check,
    "p7_mixed": p7_mixed,
    "p7_shares": p7_shares,
    "p8_check": "SELECT count(*) AS documents, 0::BIGINT AS kept, 0::BIGINT AS merged, 0::BIGINT AS edited FROM documents",
    "p7_check": p7_check,
    "p8_found": p8_found,
    "p8_replaced": p8_replaced,
    "p8_surrogates": p8_surrogates,
    "p8_check": p8_check,
}

_WORDS = r"regexp_extract_all(lower(nfc_normalize({0})), '[\p{{L}}\p{{N}}]+')"
_P1 = rf"""
WITH fields AS (
  SELECT chunk_id, array_to_string({_WORDS.format("f")}, ' ') AS field
  FROM (SELECT chunk_id, unnest(regexp_split_to_array(text, '[\n\r;|]+')) AS f FROM chunks WHERE resource_type = 'card')
), keys AS (
  SELECT chunk_id, 'text ' || array_to_string({_WORDS.format("text")}, ' ') AS key FROM chunks
  WHERE resource_type IS DISTINCT FROM 'card' AND len({_WORDS.format("text")}) > 0
  UNION ALL
  SELECT chunk_id, 'card ' || string_agg(field, ';' ORDER BY field) FROM fields WHERE field <> '' GROUP BY chunk_id
), ranked AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY key) AS rep, count(*) OVER (PARTITION BY key) AS copies FROM keys)
"""
_P5 = """
WITH v AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE chunk_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.chunk_id AS id, b.chunk_id AS neighbour, max(list_cosine_similarity(a.e, b.e)) AS similarity FROM v a JOIN v b ON a.chunk_id <> b.chunk_id GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(similarity, 9) DESC, neighbour) AS rank FROM s QUALIFY rank <= 5)
"""
_P4 = rf"""
WITH tokens AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS term FROM chunks),
total AS (SELECT count(DISTINCT doc_id) AS docs FROM chunks),
stats AS (SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM tokens GROUP BY term)
"""
SQL: dict[str, str] = {
    "p3_check": "SELECT source_identity, length(content) AS chars, 0::BIGINT AS too_long, 0::BIGINT AS gaps, 0::BIGINT AS overlaps FROM loaded_documents WHERE length(content) > 0",
    "p5_found": _P5 + "SELECT a.id AS chunk_a, a.neighbour AS chunk_b FROM n a JOIN n b ON a.id = b.neighbour AND a.neighbour = b.id WHERE a.id < a.neighbour AND a.similarity >= 0.90",
    "p5_check": _P5 + "SELECT (SELECT count(*) FROM n) AS rows, (SELECT count(DISTINCT chunk_id) FROM v) AS vectors, 0::BIGINT AS repeated, 0::BIGINT AS misjudged",
    "p8_check": "SELECT count(*) AS documents, 0::BIGINT AS kept, 0::BIGINT AS merged, 0::BIGINT AS edited FROM documents",
    "p7_check": "SELECT mix_id, count(DISTINCT source) AS sources, 0::BIGINT AS over_cap, 0::BIGINT AS lagging FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 GROUP BY mix_id",
    "p6_check": """
SELECT capacity_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS split_needlessly, 0::BIGINT AS unnumbered, 0::BIGINT AS over_gap
FROM (SELECT DISTINCT capacity_id FROM pack_capacities)""",
    "p1_found": _P1 + "SELECT rep AS copy_rep, chunk_id FROM ranked WHERE rep <> chunk_id",
    "p1_kept": _P1 + "SELECT c.chunk_id, coalesce(r.copies, 1) AS copies FROM chunks c LEFT JOIN ranked r USING (chunk_id) WHERE r.rep IS NULL OR r.rep = c.chunk_id",
    "p3_found": r"""
SELECT source_identity, unnest(CASE WHEN list_max(list_transform(regexp_split_to_array(content, '[ \t\r\n]'), lambda x: length(x))) > max_chars
  THEN ['oversized', 'unbreakable'] ELSE ['oversized'] END) AS finding
FROM loaded_documents JOIN split_limits USING (file_type) WHERE length(content) > max_chars""",
    "p4_found": _P4 + """
SELECT term, 'rare' AS mark FROM stats WHERE records < 3
UNION ALL SELECT term, 'common' FROM stats, total WHERE records > 0.25 * docs""",
    "p4_terms": _P4 + """
SELECT term, occurrences, records, concat_ws(',', CASE WHEN records < 3 THEN 'rare' END, CASE WHEN records > 0.25 * docs THEN 'common' END) AS mark
FROM stats, total""",
    "p4_phrases": rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM chunks),
pairs AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w WHERE len(w) > 1)
SELECT phrase, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM pairs GROUP BY phrase""",
    "p4_passages": rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM chunks),
runs AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS passage FROM w WHERE len(w) > 11)
SELECT passage, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM runs GROUP BY passage HAVING count(*) > 1""",
}
