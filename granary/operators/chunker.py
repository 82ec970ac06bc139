"""Splitting documents into overlapping, citable chunks at separators."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import materialize

#: Separators by preference (fixed values), looked for in the last fifth of a window.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ")
TAIL = 0.8
_SPAN = "source_identity string, doc_chunk_index int, char_start int, char_end int, text string"


class _Marks:
    """Where a text can be cut and where it is inked: positions found once, then looked up by bisection."""

    def __init__(self, text: str):
        self.separators = [(len(s), [m.start() for m in re.finditer(f"(?={re.escape(s)})", text)]) for s in SEPARATORS]
        ink = [m.span() for m in re.finditer(r"\S+", text)]
        self.begins, self.ends = [a for a, _ in ink], [b for _, b in ink]

    def cut(self, floor: int, end: int) -> int:
        """Behind the last separator of the most preferred kind that begins after ``floor`` and ends by ``end``; ``end`` if there is none."""
        for width, starts in self.separators:
            i = bisect_right(starts, end - width)
            if i and starts[i - 1] > floor:
                return starts[i - 1] + width
        return end

    def inked(self, start: int, end: int) -> tuple[int, int] | None:
        """The range without blanks at its edges; None if it is blank."""
        first, last = bisect_right(self.ends, start), bisect_left(self.begins, end) - 1
        return (max(start, self.begins[first]), min(end, self.ends[last])) if first <= last else None


def spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Offsets of the chunks of a text: stripped, none inside the one before."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and less than the size")
    marks, reach = _Marks(text), 0
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        end = marks.cut(start + int(size * TAIL), end) if end < len(text) else end
        span = marks.inked(start, end)
        # Chunks begin in order, so one that ends within the reach of those before lies inside the last.
        if span and span[1] > reach:
            reach = span[1]
            yield span
        start = end - overlap if end - overlap > start else end


def chunk_documents(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunk rows of loaded documents, with their metadata as JSON text.

    Null and blank contents have no chunk. ``global_index`` is null; :func:`number_globally`
    fills it.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and less than the size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, s, e, t[s:e]) for i, t in zip(b["source_identity"], b["content"]) if t for k, (s, e) in enumerate(spans(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["source_identity", "doc_chunk_index", "char_start", "char_end", "text"])

    pieces = docs.where(F.length("content") > 0).select("source_identity", "content").mapInPandas(run, _SPAN)
    about = docs.select("source_identity", "source_fingerprint", "relative_path", "filename", "file_type").dropDuplicates(["source_identity"])
    rows = pieces.join(about, "source_identity")
    meta = F.to_json(F.struct("source_identity", "source_fingerprint", "relative_path", "filename", "file_type"), {"ignoreNullFields": "false"})
    return rows.select(
        F.concat("source_identity", F.lit(":chunk-"), "doc_chunk_index").alias("chunk_id"), F.col("source_identity").alias("doc_id"),
        F.col("relative_path").alias("source_file"), "doc_chunk_index", F.lit(None).cast("long").alias("global_index"),
        "char_start", "char_end", F.col("source_identity").alias("content_module_id"), "text", meta.alias("metadata"),
    )


def number_globally(chunks: DataFrame, path_col: str = "source_file") -> DataFrame:
    """``global_index`` filled: 0, 1, ... by path and position, from a range sort and counts per partition.

    The sorted rows are numbered within each partition and shifted by the sizes of the
    partitions before it.
    """
    ordered = chunks.drop("global_index").orderBy(path_col, "doc_chunk_index", "chunk_id")
    tagged = ordered.withColumn("__row", F.monotonically_increasing_id())
    tagged = materialize(tagged, "numbered")
    part = F.shiftright("__row", 33)
    sizes = tagged.groupBy(part.alias("p")).count().orderBy("p").collect()  # one row per partition
    ahead, total = {}, 0
    for p, n in sizes:
        ahead[p] = total
        total += n
    if not ahead:
        return chunks
    shifts = chunks.sparkSession.createDataFrame(list(ahead.items()), "__part int, __ahead long")
    numbered = tagged.withColumn("__part", part.cast("int")).join(shifts, "__part")
    return numbered.withColumn("global_index", F.col("__ahead") + F.col("__row").bitwiseAND((1 << 33) - 1)).select(*chunks.columns)
