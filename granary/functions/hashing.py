"""Identities of sources, corpora and datasets."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def source_identity(path: Column, root: Column | None = None) -> Column:
    """Path relative to the dataset, with ``/`` as separator, lower-cased."""
    relative = F.regexp_replace(path, r"\\", "/")
    return F.lower(F.replace(relative, root, F.lit("")) if root is not None else relative)


def source_fingerprint(file_type: Column, content: Column) -> Column:
    return F.sha2(F.concat(file_type, F.lit("\0"), content), 256)


def inventory_lines(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, line)``: the lines whose hash in id order is the chunk inventory."""
    return chunks.select("chunk_id", F.concat("chunk_id", F.lit("\t"), F.sha2("text", 256), F.lit("\n")).alias("line"))


#: Hex digits of a key's hash that make a leaf and a node of an identity's tree: a million leaves, 4096 nodes.
LEAF, NODE = 5, 3


def identity(lines: DataFrame, key: str) -> DataFrame:
    """``(identity)``, one row: hash of the hashes of nodes, each of the hashes of its leaves, each over its lines in order of ``key``.

    The same tree for any number of rows; leaves and nodes are made by the cluster. No rows have an identity too.
    """

    def level(rows: DataFrame, part: Column, order: Column, line: str) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x[line]), "")
        return rows.groupBy(part.alias("part")).agg(F.sha2(joined, 256).alias("h")).withColumn("line", F.concat("part", F.lit("\t"), "h", F.lit("\n")))

    leaves = level(lines, F.substring(F.sha2(key, 256), 1, LEAF), F.struct(F.col(key).alias("k"), "line"), "line")
    nodes = level(leaves, F.substring("part", 1, NODE), F.struct("part", "line"), "line")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "")
    return nodes.agg(F.sha2(whole, 256).alias("identity"))


def chunk_inventory_sha256(chunks: DataFrame) -> str:
    """Identity of ids and texts."""
    return identity(inventory_lines(chunks), "chunk_id").first()[0]


def dataset_id(inventory: str) -> str:
    return f"ds-{inventory[:16]}"


def corpus_lines(sources: DataFrame) -> DataFrame:
    part = F.concat_ws("\0", F.col("relative_path"), F.col("file_type"), F.coalesce("source_fingerprint", F.lit("")))
    return sources.select("source_identity", F.concat(part, F.lit("\0")).alias("line"))


def corpus_fingerprint(sources: DataFrame) -> str:
    """Identity of the sources, from their paths, types and fingerprints."""
    return identity(corpus_lines(sources), "source_identity").first()[0]


def lines_sha256(lines: DataFrame, key: str) -> str:
    """One running hash of all lines in order of ``key``, for comparison with systems that use it: the lines stream through the driver, none are kept."""
    hashed = hashlib.sha256()
    for row in lines.orderBy(key, "line").select("line").toLocalIterator(prefetchPartitions=True):
        hashed.update(row[0].encode())
    return hashed.hexdigest()


def embedding_fingerprint(payload: dict) -> str:
    return hashlib.sha256(canonical_json(payload).encode()).hexdigest()


connection_sha256 = embedding_fingerprint
