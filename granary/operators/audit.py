"""Drift between a frozen dataset and a live backend: a full audit and a cheap check."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.errors import ConnectorContractError
from granary.functions import text as tx
from granary.operators import ordered
from granary.session import materialize

#: Compared besides text and metadata (fixed names of the row type).
FIELDS = ("doc_id", "source_file", "doc_chunk_index", "char_start", "char_end", "content_module_id")
STATUSES = ("unchanged", "text_changed", "id_changed", "ambiguous", "missing", "added")
MACHINE_LOCAL = "document_filepath"


def _metadata(column: Column) -> Column:
    """Top-level keys to the JSON text of their values, the machine-local key left out; empty if there is no object."""
    fields = F.map_filter(F.from_json(column, "map<string,variant>"), lambda k, _: k != MACHINE_LOCAL)
    return F.coalesce(F.transform_values(fields, lambda _, v: F.to_json(v)), F.create_map().cast("map<string,string>"))


def match(dataset: DataFrame, backend: DataFrame) -> DataFrame:
    """``(chunk_id, backend_chunk_id, status, doc_id, backend_doc_id, fields_changed, metadata_keys_added, ..._removed, ..._changed)``.

    By id first; then what is left by text, where a text is left once on either side. Texts
    left several times are ambiguous, and their backend copies count as spoken for.
    """
    columns = ["chunk_id", "metadata", *FIELDS]  # of texts only their hashes travel
    a = dataset.select(F.struct(*columns).alias("a"), F.col("chunk_id").alias("ka"), F.sha2("text", 256).alias("sha"))
    b = backend.select(F.struct(*columns).alias("b"), F.col("chunk_id").alias("kb"), F.sha2("text", 256).alias("shb"))
    same = a.join(b, a["ka"] == b["kb"], "full_outer")
    same = materialize(same, "audit-ids")
    by_id = same.where("ka is not null and kb is not null").select("a", "b", F.when(F.col("sha") == F.col("shb"), "unchanged").otherwise("text_changed").alias("status"))
    left, right = same.where("kb is null").select("a", "ka", "sha"), same.where("ka is null").select("b", "kb", F.col("shb").alias("sha"))
    sizes = left.groupBy("sha").agg(F.count("*").alias("na")).join(right.groupBy("sha").agg(F.count("*").alias("nb")), "sha")
    once = sizes.where("na = 1 and nb = 1").select("sha")
    by_text = left.join(once, "sha", "left_semi").join(right, "sha").select("a", "b", F.lit("id_changed").alias("status"))
    several = sizes.where("na > 1 or nb > 1").select("sha")
    none_b = F.lit(None).cast(dict(right.dtypes)["b"]).alias("b")
    unclear = left.join(several, "sha", "left_semi").select("a", none_b, F.lit("ambiguous").alias("status"))
    missing = left.join(sizes.select("sha"), "sha", "left_anti").select("a", none_b, F.lit("missing").alias("status"))
    added = right.join(sizes.select("sha"), "sha", "left_anti").select(F.lit(None).cast(dict(left.dtypes)["a"]).alias("a"), "b", F.lit("added").alias("status"))
    rows = by_id
    for part in (by_text, unclear, missing, added):
        rows = rows.unionByName(part)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    changed = F.array_compact(F.array(*[F.when(both & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in FIELDS]))
    rows = rows.withColumn("ma", _metadata(F.col("a.metadata"))).withColumn("mb", _metadata(F.col("b.metadata")))
    ka, kb = F.map_keys("ma"), F.map_keys("mb")
    empty = F.array().cast("array<string>")
    differing = F.filter(F.array_intersect(ka, kb), lambda k: ~F.element_at("ma", k).eqNullSafe(F.element_at("mb", k)))
    return rows.select(
        F.col("a.chunk_id").alias("chunk_id"), F.col("b.chunk_id").alias("backend_chunk_id"), "status", F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("backend_doc_id"),
        changed.alias("fields_changed"), F.when(both, F.array_sort(F.array_except(kb, ka))).otherwise(empty).alias("metadata_keys_added"),
        F.when(both, F.array_sort(F.array_except(ka, kb))).otherwise(empty).alias("metadata_keys_removed"), F.when(both, F.array_sort(differing)).otherwise(empty).alias("metadata_keys_changed"),
    )


def documents(matched: DataFrame, dataset: DataFrame, backend: DataFrame) -> DataFrame:
    """``(doc_id, status, dataset_chunks, backend_chunks, unchanged, text_changed, ...)``; see :data:`STATUSES`.

    removed: nothing found and nothing under its id; unchanged: every chunk is, and none was
    added; added: a backend document that holds no chunk of the dataset; else changed.
    """
    own = matched.where("chunk_id is not null").groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES[:-1]])
    new = matched.where("status = 'added'").groupBy(F.col("backend_doc_id").alias("doc_id")).agg(F.count("*").alias("added"))
    holds = matched.where("chunk_id is not null and backend_chunk_id is not null").groupBy(F.col("backend_doc_id").alias("doc_id")).agg(F.count("*").alias("held"))
    na = dataset.groupBy("doc_id").agg(F.count("*").alias("dataset_chunks"))
    nb = backend.groupBy("doc_id").agg(F.count("*").alias("backend_chunks"))
    all_ = na.join(nb, "doc_id", "full_outer").join(own, "doc_id", "left").join(new, "doc_id", "left").join(holds, "doc_id", "left").na.fill(0)
    found = F.col("dataset_chunks") - F.col("missing")
    status = (
        F.when((F.col("dataset_chunks") == 0) & (F.col("held") == 0) & (F.col("added") > 0), "added")
        .when(F.col("dataset_chunks") == 0, "changed")
        .when((found == 0) & (F.col("backend_chunks") == 0), "removed")
        .when((F.col("unchanged") == F.col("dataset_chunks")) & (F.col("added") == 0), "unchanged")
        .otherwise("changed")
    )
    return all_.select("doc_id", status.alias("status"), "dataset_chunks", "backend_chunks", *STATUSES)


def profile(chunks: DataFrame) -> DataFrame:
    """One row: lengths of chunks, chunks per document, and the overlap of neighbours.

    ``p90`` is the element at ``floor(0.9 n)`` of the sorted lengths, from counts per length.
    """
    n = F.length("text")
    lengths = chunks.agg(F.count("*").alias("chunks"), F.min(n).alias("min"), F.median(n).alias("median"), F.round(F.avg(n), 1).alias("mean"), F.max(n).alias("max"))
    per = chunks.groupBy("doc_id").count().agg(F.median("count").alias("chunks_per_doc_median"), F.count("*").alias("docs"))
    by_length = chunks.groupBy(n.alias("length")).count()
    upto = by_length.withColumn("upto", F.sum("count").over(Window.orderBy("length"))).withColumn("total", F.sum("count").over(Window.partitionBy()))
    p90 = upto.where(F.col("upto") > F.least(F.floor(F.col("total") * 0.9), F.col("total") - 1)).agg(F.min("length").alias("p90"))
    pairs = ordered.following(chunks.select("doc_id", "doc_chunk_index", "chunk_id", "text"), ["text"]).where("next_text is not null")
    pairs = pairs.select(tx.overlap_of("text", "next_text").alias("o"))
    over = pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("o") > 0).alias("overlapping"), F.median("o").alias("overlap_median"), F.max("o").alias("overlap_max"))
    found: dict = {}
    for part in (lengths, p90, per, over):  # each has exactly one row
        found |= part.first().asDict()
    names = ["chunks", "min", "median", "mean", "max", "p90", "docs", "chunks_per_doc_median", "pairs", "overlapping", "overlap_median", "overlap_max"]
    whole = {"chunks", "min", "max", "p90", "docs", "pairs", "overlapping", "overlap_max"}
    row = tuple(None if found[n] is None else int(found[n]) if n in whole else float(found[n]) for n in names)
    return chunks.sparkSession.createDataFrame([row], ", ".join(f"`{n}` {'long' if n in whole else 'double'}" for n in names))


def metadata_keys(chunks: DataFrame) -> DataFrame:
    """``(key, chunks)``: how many chunks carry each top-level metadata key."""
    return chunks.select(F.explode(F.map_keys(_metadata(F.col("metadata")))).alias("key")).groupBy("key").agg(F.count("*").alias("chunks"))


@dataclass
class Audit:
    """What an audit found: rows per chunk and document, named counts, and whether both sides agree."""

    chunks: DataFrame
    documents: DataFrame
    signals: dict[str, int]
    in_sync: bool


def audit(dataset: DataFrame, backend: DataFrame) -> Audit:
    """Compare all chunks. Backend ids must be unique; global ordinals are not compared."""
    repeated = backend.groupBy("chunk_id").count().where("count > 1 or chunk_id is null").limit(5).collect()
    if repeated:
        raise ConnectorContractError(f"the backend repeats chunk ids: {', '.join(str(r[0]) for r in repeated)}")
    rows = materialize(match(dataset, backend), "audit-chunks")
    docs = materialize(documents(rows, dataset, backend), "audit-documents")
    named = {"text_changed": "chunk_text_changed", "id_changed": "chunk_ids_changed", "missing": "chunks_missing", "added": "chunks_added", "ambiguous": "chunks_ambiguous"}
    meta = F.size("metadata_keys_added") + F.size("metadata_keys_removed") + F.size("metadata_keys_changed") > 0
    one = rows.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in named.items()], F.count_if(meta).alias("chunk_metadata_changed"), F.count_if(F.size("fields_changed") > 0).alias("chunk_fields_changed")).first()
    recut = (F.col("status") == "changed") & (F.col("dataset_chunks") > 0) & (F.col("backend_chunks") > 0) & (F.col("dataset_chunks") != F.col("backend_chunks"))
    two = docs.agg(F.count_if(F.col("status") == "removed").alias("documents_removed"), F.count_if(F.col("status") == "added").alias("documents_added"), F.count_if(recut).alias("documents_chunk_count_changed")).first()
    ka, kb = metadata_keys(dataset).select("key"), metadata_keys(backend).select("key")
    signals = one.asDict() | two.asDict() | {"metadata_keys_added": kb.join(ka, "key", "left_anti").count(), "metadata_keys_removed": ka.join(kb, "key", "left_anti").count()}
    signals = {k: v for k, v in signals.items() if v}
    return Audit(rows, docs, signals, not signals)


def structure(dataset: DataFrame, backend: DataFrame) -> DataFrame:
    """``(chunk_id, difference)``: missing, added, moved_document or moved_position ids. Only ids and positions are read; an unknown position is not compared."""
    a = dataset.select("chunk_id", F.col("doc_id").alias("da"), F.col("doc_chunk_index").alias("ia"), F.lit(1).alias("xa"))
    b = backend.select("chunk_id", F.col("doc_id").alias("db"), F.col("doc_chunk_index").alias("ib"), F.lit(1).alias("xb"))
    kind = (
        F.when(F.col("xb").isNull(), "missing").when(F.col("xa").isNull(), "added").when(F.col("da") != F.col("db"), "moved_document").when(F.col("ia") != F.col("ib"), "moved_position")
    )
    return a.join(b, "chunk_id", "full_outer").select("chunk_id", kind.alias("difference")).where("difference is not null")


def sample_ids(ids: list[str], percent: float, seed: int) -> list[str]:
    """A replayable sample without replacement of ``ceil(n * percent / 100)`` ids."""
    ordered_ids = sorted(ids)
    size = min(len(ordered_ids), math.ceil(len(ordered_ids) * percent / 100))
    return random.Random(seed).sample(ordered_ids, size)


def sampled_text_changes(dataset: DataFrame, backend: DataFrame, percent: float, seed: int) -> DataFrame:
    """``(chunk_id, state)`` of a sample drawn by a keyed hash: same, text_changed or missing.

    The draw is replayable and needs no list of ids on the driver: exactly
    ``ceil(n * percent / 100)`` chunks with the smallest hashes.
    """
    size = math.ceil(dataset.count() * percent / 100)
    drawn = dataset.select("chunk_id", "text").orderBy(F.xxhash64(F.lit(seed), "chunk_id"), "chunk_id").limit(size)
    there = backend.select("chunk_id", F.col("text").alias("b"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("text").eqNullSafe(F.col("b")), "same").otherwise("text_changed")
    return drawn.join(there, "chunk_id", "left").select("chunk_id", state.alias("state"))
