"""Cutting oversized texts at natural boundaries.

Boundaries (ends of paragraphs, lines, sentences, words) get a strength; a sparse table
answers "the strongest boundary in this window, the rightmost of equals" in constant
time. Each piece ends at the best boundary of its permissible window; the next piece
starts at most ``overlap`` characters earlier, at a boundary too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPH, LINE, SENTENCE, WORD_END = 4, 3, 2, 1
CUT_NAMES = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", WORD_END: "word", 0: "forced", -1: "end"}
_BLANKS = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_STOPS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]}»”’"], np.uint32)
#: The characters that break a run, as the limit on unbreakable runs defines them.
RUN_BREAKS = "\t\n\r "
_RUN_BREAKS = np.array([ord(c) for c in RUN_BREAKS], np.uint32)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def boundaries(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions after each run of blanks, ascending, and their strengths."""
    n = len(cp)
    blank = np.zeros(n + 2, np.int8)
    blank[1:-1] = np.isin(cp, _BLANKS)
    step = np.diff(blank)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    keep = (start > 0) & (end < n)
    start, end = start[keep], end[keep]
    newline = (cp == 10) | (cp == 0x85) | (cp == 0x2028) | (cp == 0x2029)
    cr = cp == 13
    newline |= cr & ~np.append(cp[1:] == 10, False)
    lines = np.concatenate([[0], np.cumsum(newline)])
    breaks = lines[end] - lines[start]
    before = start - 1
    last = cp[before]
    closing = np.isin(last, _CLOSERS) & (before > 0)
    last = np.where(closing, cp[np.maximum(before - 1, 0)], last)
    strength = np.where(np.isin(last, _STOPS), SENTENCE, WORD_END)
    strength = np.where(breaks == 1, LINE, strength)
    strength = np.where((breaks > 1) | (cp[start] == 0x2029), PARAGRAPH, strength)
    return end, strength


class RangeMax:
    """Sparse table over boundary strengths; the rightmost of the strongest wins."""

    def __init__(self, strength: np.ndarray):
        size = max(1, len(strength))
        self.size = size
        rows = [strength.astype(np.int64) * size + np.arange(len(strength))]
        width = 1
        while 2 * width <= len(strength):
            rows.append(np.maximum(rows[-1][:-width], rows[-1][width:]))
            width *= 2
        self.rows = rows

    def best(self, lo: int, hi: int) -> int:
        """Index of the best boundary in ``[lo, hi)``, which must not be empty."""
        level = (hi - lo).bit_length() - 1
        row = self.rows[level]
        return int(max(row[lo], row[hi - (1 << level)]) % self.size)


def split(text: str, limit: int, overlap: int, shortest: float = 0.5) -> list[tuple[int, int, int]]:
    """``(start, end, strength of the cut)`` of each piece; one piece if the text is within ``limit``.

    A piece is cut at the strongest boundary that leaves it at least ``shortest`` of the
    limit; failing that at the last boundary that still makes progress; failing that,
    inside an unbreakable run, at the limit. The next piece starts at the first boundary
    at most ``overlap`` characters before the cut, at the cut if there is none, and, after
    a cut inside a run, exactly ``overlap`` before it.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, -1)] if n else []
    overlap = max(0, min(overlap, limit - 1))
    pos, strength = boundaries(points(text))
    table = RangeMax(strength)
    out, start, end = [], 0, 0
    while n - start > limit:
        hi = int(np.searchsorted(pos, start + limit, "right"))
        least = max(end, start + overlap)
        lo = int(np.searchsorted(pos, max(least, start + int(limit * shortest) - 1), "right"))
        if lo >= hi:
            lo = max(int(np.searchsorted(pos, least, "right")), hi - 1)
        if lo < hi:
            cut = table.best(lo, hi)
            new, kind = int(pos[cut]), int(strength[cut])
            back = int(np.searchsorted(pos, max(new - overlap, start + 1), "left"))
            following = int(pos[back]) if overlap else new
        else:
            new, kind = start + limit, 0
            following = new - overlap
        out.append((start, new, kind))
        start, end = max(following, start + 1), new
    out.append((start, n, -1))
    return out


def longest_run(cp: np.ndarray) -> int:
    """Length of the longest run without space, tab, carriage return or line feed."""
    stops = np.flatnonzero(np.isin(cp, _RUN_BREAKS))
    return int(np.diff(np.concatenate([[-1], stops, [len(cp)]])).max()) - 1 if len(cp) else 0


_PIECE = "item string, doc_chunk_index int, char_start int, char_end int, text string, cut string, run_cuts int, n_chars int, longest_run int, max_chars int, overlap_chars int"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _PIECE.split(", ")]
    for b in batches:
        rows: list[tuple] = []
        for item, content, limit, overlap in zip(b["item"], b["content"], b["max_chars"], b["overlap_chars"]):
            bounded = limit is not None and limit == limit and limit > 0
            limit_ = int(limit) if bounded else max(1, len(content))
            overlap_ = int(overlap) if overlap is not None and overlap == overlap else 0
            run = longest_run(points(content)) if len(content) > limit_ else 0
            cuts = 0
            for i, (s, e, kind) in enumerate(split(content, limit_, overlap_)):
                inside = e < len(content) and content[e - 1] not in RUN_BREAKS and content[e] not in RUN_BREAKS
                cuts += inside
                rows.append((item, i, s, e, content[s:e], CUT_NAMES[kind], cuts if inside else 0, len(content), run, limit_ if bounded else None, overlap_))
        out = pd.DataFrame(rows, columns=columns)
        out["max_chars"] = out["max_chars"].astype("Int32")
        yield out


def split_oversized(docs: DataFrame, limits: DataFrame, id_col: str = "source_identity", text_col: str = "content", type_col: str = "file_type") -> DataFrame:
    """Pieces of every document: ``source_identity, doc_chunk_index, char_start, char_end, text, cut, run_cuts, n_chars, longest_run, max_chars, overlap_chars``.

    Offsets and lengths count code points. Documents within the limit, and those whose
    type is null or has no limit, come out whole; null or empty content yields no piece.
    ``cut`` says what the piece ends at; ``run_cuts`` numbers the cuts of a document that fall inside a run without
    blanks, 0 for other pieces. ``longest_run`` (0 unless oversized) is the
    longest run without blanks. A null id is kept; repeated rows yield repeated pieces.
    """
    bounds = limits.where(F.col("file_type").isNotNull()).groupBy("file_type").agg(F.min("max_chars").alias("max_chars"), F.min("overlap_chars").alias("overlap_chars"))
    rows = docs.where(F.length(docs[text_col]) > 0).select(docs[id_col].alias("item"), docs[text_col].alias("content"), docs[type_col].alias("kind"))
    rows = rows.join(bounds, rows["kind"] == bounds["file_type"], "left").select("item", "content", "max_chars", "overlap_chars")
    return rows.mapInPandas(_pieces, _PIECE).withColumnRenamed("item", id_col)


def oversized_findings(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """``(source_identity, finding)``: ``oversized`` and ``unbreakable`` documents, read off their pieces.

    A document is oversized if its first piece does not reach its end. A run longer than the limit fits in no
    piece, so some piece ends inside of it: of documents with such a cut the longest run decides.
    """
    pieces = split_oversized(docs, limits)
    oversized = (F.col("doc_chunk_index") == 0) & (F.col("char_end") < F.col("n_chars"))
    unbreakable = (F.col("run_cuts") == 1) & (F.col("longest_run") > F.col("max_chars"))
    finding = F.array_compact(F.array(F.when(oversized, F.lit("oversized")), F.when(unbreakable, F.lit("unbreakable"))))
    return pieces.select("source_identity", F.explode(finding).alias("finding"))


def check(pieces: DataFrame, id_col: str = "source_identity") -> DataFrame:
    """``(source_identity, pieces, chars, too_long, gaps, overlaps)`` per document: pieces over the limit and places where
    the next piece leaves a gap or steps back further than allowed; ``chars`` is where the last piece ends."""
    from pyspark.sql.window import Window

    before = F.lag("char_end").over(Window.partitionBy(id_col).orderBy("doc_chunk_index"))
    rows = pieces.withColumn("before", before)
    first = F.col("doc_chunk_index") == 0
    gap = F.when(first, F.col("char_start") > 0).otherwise(F.col("before").isNull() | (F.col("char_start") > F.col("before")) | (F.col("char_end") <= F.col("before")))
    wide = ~first & (F.col("before") - F.col("char_start") > F.col("overlap_chars"))
    return rows.groupBy(id_col).agg(
        (F.max("doc_chunk_index") + 1).cast("long").alias("pieces"), F.max("char_end").cast("long").alias("chars"), F.count_if(F.length("text") > F.col("max_chars")).alias("too_long"), F.count_if(gap).alias("gaps"), F.count_if(wide).alias("overlaps"),
    )
