"""Frozen datasets: a folder with a manifest, the chunks and the sources, verified on reading.

The working copy of the chunks is Parquet and its identity is computed by the cluster; the
manifest is written last, so a folder without one was never finished.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import schema
from granary.errors import DatasetIntegrityError
from granary.functions import hashing
from granary.session import names_in, read_text, write_text
from granary.sources.files import jsonl_lines

SPEC, SPEC_VERSION, TAG = "granary-dataset", "1.0", "granary-dataset-core/1"
LOCAL_KEY = "document_filepath"


@dataclass(frozen=True)
class Dataset:
    path: str
    manifest: dict
    chunks: DataFrame
    sources: DataFrame
    verified: bool
    warnings: tuple[str, ...] = ()

    @property
    def dataset_id(self) -> str:
        return self.manifest["dataset_id"]


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def prepare(chunks: DataFrame) -> DataFrame:
    """Chunk rows fit to be frozen: the contract checked, machine-local metadata and embeddings dropped."""
    broken = schema.contract_violations(chunks).collect()
    if broken:
        raise DatasetIntegrityError("; ".join(f"{r.rule}: {r.violations}" for r in broken))
    fields = F.map_filter(F.from_json("metadata", "map<string,variant>"), lambda k, _: k != LOCAL_KEY)
    kept = F.when(F.col("metadata").contains(LOCAL_KEY), F.to_json(fields)).otherwise(F.coalesce("metadata", F.lit("{}")))
    return chunks.withColumn("metadata", kept).select(*schema.CHUNK_COLUMNS)


def source_list(chunks: DataFrame) -> DataFrame:
    """One row per source from its chunks' metadata; of several chunks the first in order counts."""
    value = lambda k: F.get_json_object("metadata", f"$.{k}")
    rows = chunks.select(
        F.coalesce(value("source_identity"), "doc_id").alias("source_identity"), F.coalesce(value("source_fingerprint"), F.lit("")).alias("source_fingerprint"),
        F.coalesce(value("relative_path"), "source_file").alias("relative_path"), F.coalesce(value("filename"), F.element_at(F.split("source_file", "/"), -1)).alias("filename"),
        F.coalesce(value("file_type"), F.lower(F.regexp_extract("source_file", r"\.([A-Za-z0-9]+)$", 1))).alias("file_type"),
        F.struct(F.coalesce("global_index", F.lit(1 << 60)), F.coalesce("doc_chunk_index", F.lit(1 << 30)), "chunk_id").alias("at"),
    )
    first = rows.groupBy("source_identity").agg(F.min_by(F.struct(*schema.SOURCE_COLUMNS[1:]), "at").alias("x"))
    return first.select("source_identity", "x.*")


def core_sha256(manifest: dict, inventory: str, corpus: str) -> str:
    """Digest of the manifest (without itself) and the two content identities."""
    body = {k: v for k, v in manifest.items() if k != "core_sha256"}
    parts = [("manifest", hashlib.sha256(hashing.canonical_json(body).encode()).hexdigest()), ("chunks", inventory), ("sources", corpus)]
    return hashlib.sha256((TAG + "\n" + "".join(f"{n}\t{h}\n" for n, h in parts)).encode()).hexdigest()


def write(chunks: DataFrame, path: str, name: str, chunking: dict, sources: DataFrame | None = None, created_at: str | None = None, derived_from: dict | None = None, interchange: bool = False) -> Dataset:
    """Freeze ``chunks`` under ``path``, which must be empty. ``interchange`` also writes the byte-exact JSON lines."""
    spark = chunks.sparkSession
    if names_in(spark, path):
        raise FileExistsError(f"{path} is not empty")
    rows = prepare(chunks)
    rows.repartitionByRange("doc_id", "chunk_id").sortWithinPartitions("doc_id", "doc_chunk_index").write.mode("errorifexists").parquet(f"{path}/data/chunks")
    rows = spark.read.schema(schema.CHUNK).parquet(f"{path}/data/chunks")
    (sources or source_list(rows)).select(*schema.SOURCE_COLUMNS).write.parquet(f"{path}/data/sources")
    listed = spark.read.parquet(f"{path}/data/sources")
    types = {r[0]: r[1] for r in listed.groupBy("file_type").count().orderBy("file_type").collect()}
    count = rows.count()
    inventory, corpus = hashing.chunk_inventory_sha256(rows), hashing.corpus_fingerprint(listed)
    manifest = {
        "spec": SPEC, "spec_version": SPEC_VERSION, "dataset_id": hashing.dataset_id(inventory), "name": name, "created_at": created_at or now(), "chunking": chunking,
        "sources": {"source_count": listed.count(), "file_types": types}, "chunk_count": count, "inventory_method": "tree", "chunk_inventory_sha256": inventory, "corpus_fingerprint": corpus,
    }
    if derived_from:
        manifest["derived_from"] = derived_from
    manifest["core_sha256"] = core_sha256(manifest, inventory, corpus)
    if interchange:
        with open(f"{path}/data/chunks.jsonl", "w", encoding="utf-8", newline="\n") as f:
            f.writelines(jsonl_lines(rows, [F.col("doc_id"), F.col("doc_chunk_index"), F.col("chunk_id")]))
    write_json(spark, f"{path}/dataset.json", manifest)
    return read(spark, path)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write a small file whole or not at all."""
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def read(spark: SparkSession, path: str, verify: bool = True) -> Dataset:
    """Open a dataset. With ``verify`` every identity is recomputed and a difference raises; without, nothing is read but the manifest."""
    try:
        manifest = json.loads(read_text(spark, f"{path}/dataset.json"))
    except (OSError, ValueError, FileNotFoundError) as e:
        raise DatasetIntegrityError(f"{path}: no readable manifest") from e
    if manifest.get("spec") != SPEC or str(manifest.get("spec_version", "")).split(".")[0] != "1":
        raise DatasetIntegrityError(f"{path}: not a dataset of this format")
    chunks = spark.read.schema(schema.CHUNK).parquet(f"{path}/data/chunks")
    sources = spark.read.parquet(f"{path}/data/sources")
    if not verify:
        return Dataset(path, manifest, chunks, sources, False)
    inventory, corpus = hashing.chunk_inventory_sha256(chunks), hashing.corpus_fingerprint(sources)
    facts = {
        "chunk_inventory_sha256": inventory, "dataset_id": hashing.dataset_id(inventory), "corpus_fingerprint": corpus, "chunk_count": chunks.count(),
        "core_sha256": core_sha256(manifest, inventory, corpus),
    }
    wrong = tuple(f"{k} is {manifest.get(k)!r}, recomputed {v!r}" for k, v in facts.items() if manifest.get(k) != v)
    if wrong:
        raise DatasetIntegrityError(f"{path}: " + "; ".join(wrong))
    return Dataset(path, manifest, chunks, sources, True)


# Areas beside the core -------------------------------------------------------------------


def write_envelope(dataset: Dataset, area: str, tool: str, body: dict) -> str:
    """Record a tool's artefact in ``area`` (``extensions`` or ``analysis``), bound to the core it was made from."""
    if area not in ("extensions", "analysis") or not tool or "/" in tool or tool.startswith("."):
        raise ValueError("an envelope belongs to a named tool under extensions or analysis")
    path = f"{dataset.path}/{area}/{tool}/{area.rstrip('s')}.json"
    write_json(dataset.chunks.sparkSession, path, {"tool": tool, "created_at": now(), "core_sha256": dataset.manifest["core_sha256"], **body})
    return path


def list_envelopes(dataset: Dataset, area: str) -> list[dict]:
    """Envelopes with ``problems``: unreadable ones and those of another core are listed, not hidden."""
    out = []
    root, spark = f"{dataset.path}/{area}", dataset.chunks.sparkSession
    for tool in names_in(spark, root):
        problems, body = [], {}
        try:
            body = json.loads(read_text(spark, f"{root}/{tool}/{area.rstrip('s')}.json"))
        except (OSError, ValueError):
            problems.append("no readable envelope")
        if body and body.get("core_sha256") != dataset.manifest["core_sha256"]:
            problems.append("made from another core")
        out.append({"tool": tool, **body, "problems": problems})
    return out


def sync(dataset: Dataset, backend: DataFrame, path: str, audit_id: str | None = None, name: str | None = None, about: dict | None = None) -> Dataset:
    """A new dataset with the backend's chunks, whose manifest names the one it comes from."""
    origin = {k: v for k, v in (about or {}).items() if v} | {"dataset_id": dataset.dataset_id, "core_sha256": dataset.manifest["core_sha256"]}
    if audit_id:
        try:
            cited = json.loads(read_text(backend.sparkSession, f"{dataset.path}/audits/{audit_id}/summary.json"))
        except FileNotFoundError as e:
            raise DatasetIntegrityError(f"no audit {audit_id} of this dataset") from e
        if cited["core_sha256"] != dataset.manifest["core_sha256"]:
            raise DatasetIntegrityError(f"audit {audit_id} is of another core")
        origin["audit_id"] = audit_id
    return write(backend, path, name or dataset.manifest["name"], dataset.manifest["chunking"], derived_from=origin)


def record_audit(dataset: Dataset, found, connector: str, label: str = "", host: str = "") -> str:
    """Write an audit's rows and summary under the dataset; audits are never overwritten."""
    audit_id = f"audit-{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
    root = f"{dataset.path}/audits/{audit_id}"
    found.chunks.write.mode("errorifexists").parquet(f"{root}/chunks")
    found.documents.write.mode("errorifexists").parquet(f"{root}/documents")
    write_json(found.chunks.sparkSession, f"{root}/summary.json", {"audit_id": audit_id, "connector": connector, "label": label, "host": host, "created_at": now(), "core_sha256": dataset.manifest["core_sha256"], "in_sync": found.in_sync, "signals": found.signals})
    return audit_id


def list_audits(dataset: Dataset) -> list[dict]:
    spark, root = dataset.chunks.sparkSession, f"{dataset.path}/audits"
    return [json.loads(read_text(spark, f"{root}/{name}/summary.json")) for name in names_in(spark, root)]


def read_legacy(spark: SparkSession, path: str) -> Dataset:
    """A folder of an earlier layout: ``chunks.jsonl`` (or ``data/chunks.jsonl``) and a manifest if there is one; nothing in it is verified."""
    from granary.sources.files import read_chunks_jsonl

    try:
        manifest = json.loads(read_text(spark, f"{path}/dataset.json"))
    except (OSError, ValueError):
        manifest = {}
    places = [f"{path}/{x}chunks.jsonl" for x in ("data/", "") if "chunks.jsonl" in names_in(spark, f"{path}/{x}".rstrip("/"))]
    if not places:
        raise DatasetIntegrityError(f"{path}: no chunks.jsonl")
    chunks = read_chunks_jsonl(spark, places[0])
    return Dataset(path, {"name": path.rstrip("/").rsplit("/", 1)[-1], "dataset_id": None, **manifest}, chunks, source_list(chunks), False, ("read from an earlier layout, not verified",))
