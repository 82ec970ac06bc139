"""Reading document folders and chunk files."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.errors import DatasetIntegrityError
from granary.functions import hashing
from granary.schema import CHUNK, CHUNK_COLUMNS

EXTENSIONS = ("txt", "md", "pdf", "docx", "rtf")
#: The optional library each binary format needs.
PARSERS = {"pdf": "pypdf", "docx": "python-docx", "rtf": "striprtf"}


def decode_text(content: bytes) -> str:
    """UTF-8 without its byte-order mark, all line ends as line feeds; invalid bytes raise."""
    return content.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")


def parse(file_type: str, content: bytes) -> str:
    """The text of a file. Formats with a parser of their own import it only when needed."""
    if file_type in ("txt", "md"):
        return decode_text(content)
    try:
        if file_type == "pdf":
            from pypdf import PdfReader

            return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
        if file_type == "docx":
            from docx import Document

            return "\n".join(p.text for p in Document(io.BytesIO(content)).paragraphs)
        if file_type == "rtf":
            from striprtf.striprtf import rtf_to_text

            return rtf_to_text(decode_text(content))
    except ImportError as e:
        raise ImportError(f"reading .{file_type} files needs the package {PARSERS[file_type]}") from e
    raise ValueError(f"no reader for .{file_type} files")


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file below ``folder``: ``filename, filepath, relative_path, file_type, content, source_identity, source_fingerprint``.

    Folders whose name begins with a dot are left out at every level, as are other
    extensions. A file that cannot be read fails the job with its path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    root = folder.rstrip("/")
    at = F.locate(root, "path")
    relative = F.when(at > 0, F.ltrim(F.expr(f"substring(path, locate('{_sql(root)}', path) + {len(root)})"), F.lit("/"))).otherwise(F.col("path"))
    files = files.withColumn("relative_path", F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))))
    files = files.withColumn("file_type", F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z0-9]+)$", 1)))
    files = files.where(F.col("file_type").isin(*EXTENSIONS) & ~F.col("relative_path").rlike(r"(^|/)\.[^/]*/"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for path, kind, content in zip(b["path"], b["file_type"], b["content"]):
                try:
                    texts.append(parse(kind, bytes(content)))
                except (UnicodeDecodeError, ValueError) as e:
                    raise ValueError(f"{path}: {e}") from e
            yield pd.DataFrame({"path": b["path"], "relative_path": b["relative_path"], "file_type": b["file_type"], "content": texts})

    docs = files.mapInPandas(read, "path string, relative_path string, file_type string, content string")
    return docs.select(
        F.element_at(F.split("relative_path", "/"), -1).alias("filename"), F.col("path").alias("filepath"), "relative_path", "file_type", "content",
        hashing.source_identity(F.col("relative_path")).alias("source_identity"), hashing.source_fingerprint(F.col("file_type"), F.col("content")).alias("source_fingerprint"),
    )


def _sql(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def read_chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of a JSON-lines file. Blank lines are skipped; a broken line or an unknown key is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    known = F.array(*[F.lit(c) for c in CHUNK_COLUMNS])
    bad = lines.where(keys.isNull() | (F.size(F.array_except(keys, known)) > 0)).select(F.substring("value", 1, 200)).limit(1).collect()
    if bad:
        raise DatasetIntegrityError(f"not a chunk row: {bad[0][0]}")
    parsed = F.from_json("value", CHUNK, {"mode": "FAILFAST"}).alias("x")
    rows = lines.select(parsed, F.get_json_object("value", "$.metadata").alias("m")).select("x.*", "m")
    return rows.withColumn("metadata", F.coalesce("m", F.lit("{}"))).select(*CHUNK_COLUMNS)


def jsonl_lines(chunks: DataFrame, order: list[Column]) -> Iterator[str]:
    """Lines of the interchange file, streamed in order: fixed key order, text as it is."""
    for row in chunks.select(*CHUNK_COLUMNS).orderBy(*order).toLocalIterator(prefetchPartitions=True):
        record = row.asDict()
        record["metadata"] = json.loads(record["metadata"] or "{}")
        yield json.dumps(record, ensure_ascii=False) + "\n"
