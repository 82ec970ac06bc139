"""Occurrences and record counts of all n-grams, from suffix arrays.

Chunks are laid out so that a document's chunks lie together; a document too large for
one task is spread over several by a salt. Each task builds the suffix array of a block of
texts, whole suffixes by prefix doubling, and the lengths of common prefixes. A maximal run of
suffixes with a common prefix of at least n words is the interval of an n-gram: its size is the
number of occurrences. Suffixes of one document that follow each other in an interval are
duplicates within the record; every suffix has one predecessor of its document, and their common
prefix says for which n it is one, so record counts of all n come from one pass. Blocks are
summed; the parts of a spread document are first merged per n-gram, so it counts once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.words import words
from granary.session import materialize

#: Tokens sorted at once in a task (about 100 MB).
BLOCK_TOKENS = 400_000
#: A document with more chunks than this is spread over several tasks.
ROWS_PER_PART = 2000
#: Up to this many spread documents travel by broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000
_GRAM = "gram string, n int, part string, occurrences long, records long"


class SuffixArray:
    """Sorted suffixes of token sequences; ``tokens`` are ids from 0, -1 where a sequence ends. No suffix runs past the end of its sequence."""

    def __init__(self, tokens: np.ndarray):
        size = len(tokens)
        first = tokens.astype(np.int64)
        ends = np.flatnonzero(first < 0)
        first[ends] = first.max(initial=-1) + 1 + np.arange(len(ends))  # every end differs from all others
        #: ``ranks[k]``: equal for two suffixes iff their first 2**k tokens are.
        self.ranks = [self._dense(first)]
        width = 1
        while size:
            old = self.ranks[-1]
            members = np.bincount(old, minlength=size)
            tied = np.flatnonzero(members[old] > 1)
            if not len(tied):
                break
            # A rank is the number of smaller suffixes, so refining a group leaves the others as they are.
            follow = np.minimum(tied + width, size - 1)
            order = np.argsort(old[tied] * (size + 1) + old[follow], kind="stable")
            at = tied[order]
            group, then = old[at], old[follow[order]]
            opens = np.concatenate([[True], group[1:] != group[:-1]])
            changes = opens | np.concatenate([[True], then[1:] != then[:-1]])
            place = np.arange(len(at))
            start, change = np.maximum.accumulate(np.where(opens, place, 0)), np.maximum.accumulate(np.where(changes, place, 0))
            new = old.copy()
            new[at] = group + change - start
            self.ranks.append(new)
            width *= 2
        self.order = np.argsort(self.ranks[-1], kind="stable") if size else np.zeros(0, np.int64)
        self.order = self.order[tokens[self.order] >= 0]
        #: Common prefix of each suffix with the one before.
        self.common = np.concatenate([[0], self.common_prefix(self.order[:-1], self.order[1:])]).astype(np.int64)[: len(self.order)]

    @staticmethod
    def _dense(values: np.ndarray) -> np.ndarray:
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        changes = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(values)]
        ranks = np.empty(len(values), np.int64)
        ranks[order] = np.maximum.accumulate(np.where(changes, np.arange(len(values)), 0))
        return ranks

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at ``a`` and ``b``, by halving strides over the ranks."""
        a, b = a.copy(), b.copy()
        size = len(self.ranks[0])
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            inside = (a < size) & (b < size)
            same = inside.copy()
            same[inside] = rank[a[inside]] == rank[b[inside]]
            step = same.astype(np.int64) << k
            a += step
            b += step
            length += step
        return length


def ngram_intervals(tokens: np.ndarray, docs: np.ndarray, sizes: Iterable[int] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: a position of every distinct n-gram, its occurrences, and its number of documents.

    ``docs`` gives each position's document, -1 for none, which is no record. ``sizes``: the n asked for; None for all there are.
    """
    suffixes = SuffixArray(tokens)
    order, common = suffixes.order, suffixes.common
    if not len(order):
        return
    ends = np.flatnonzero(tokens < 0)
    room = ends[np.searchsorted(ends, order)] - order  # words to the end of the sequence
    doc = docs[order]
    # The suffix of the same document before each, in order of the array, and their common prefix.
    by = np.lexsort((np.arange(len(order)), doc))
    shared = np.full(len(order), -1, np.int64)
    again = doc[by[1:]] == doc[by[:-1]]
    shared[by[1:][again]] = suffixes.common_prefix(order[by[:-1][again]], order[by[1:][again]])
    nowhere = doc < 0
    for n in range(1, int(room.max()) + 1) if sizes is None else sorted({x for x in sizes if 0 < x <= int(room.max())}):
        full = room >= n
        run = np.cumsum(common[full] < n) - 1
        first = np.flatnonzero(np.diff(run, prepend=-1))
        occurrences = np.bincount(run)
        repeated = (shared[full] >= n) | nowhere[full]
        yield n, order[full][first], occurrences, occurrences - np.bincount(run[repeated], minlength=len(occurrences))


def _block(texts: list[str], docs: list[int], parts: dict[int, str], sizes: tuple[int, ...] | None) -> pd.DataFrame:
    ids: dict[str, int] = {}
    tokens, owner = [], []
    for text, doc in zip(texts, docs):
        found = [ids.setdefault(w, len(ids)) for w in words(text)]
        found.append(-1)
        tokens.extend(found)
        owner.extend([doc] * len(found))
    names = list(ids)
    token, own = np.array(tokens, np.int32), np.array(owner, np.int32)
    split = np.array(sorted(parts), np.int32)
    frames = []
    # Whole documents together; each spread document's part by itself, under its own name.
    for label, mask in [(None, ~np.isin(own, split)), *[(parts[p], own == p) for p in split.tolist()]]:
        t = token[mask]
        for n, where, occurrences, records in ngram_intervals(t, own[mask], sizes):
            gram = [" ".join(names[t[i + k]] for k in range(n)) for i in where.tolist()] if n > 1 else [names[i] for i in t[where].tolist()]
            frames.append(pd.DataFrame({"gram": gram, "n": np.int32(n), "part": label, "occurrences": occurrences, "records": records}))
    return pd.concat(frames) if frames else pd.DataFrame(columns=["gram", "n", "part", "occurrences", "records"])


def _blocks(sizes: tuple[int, ...] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: list[str] = []
        docs: list[int] = []
        parts: dict[int, str] = {}
        current, number, chars = object(), -1, 0
        for b in batches:
            for text, doc, salts in zip(b["text"], b["doc"], b["salts"]):
                # A block ends between documents, or anywhere in one that is spread.
                if chars > 6 * BLOCK_TOKENS and (doc != current or salts > 1):
                    yield _block(texts, docs, parts, sizes)
                    texts, docs, parts, chars, number, current = [], [], {}, 0, -1, object()
                if doc != current:
                    current, number = doc, number + 1
                    if salts > 1 and doc is not None:
                        parts[number] = doc
                texts.append(text)
                docs.append(-1 if doc is None else number)
                chars += len(text)
        if texts:
            yield _block(texts, docs, parts, sizes)

    return run


def ngram_counts(df: DataFrame, doc_col: str = "doc_id", text_col: str = "text", id_col: str = "chunk_id", sizes: Iterable[int] | None = (1,)) -> DataFrame:
    """``(gram, n, occurrences, records)`` of every n-gram whose n is in ``sizes``, words joined by a space; of every n with None.

    Suffixes are sorted whole whatever ``sizes`` says, which only chooses what is written: all n-grams of a text of L
    words are L * (L + 1) / 2. ``records`` counts distinct documents. N-grams do not cross from one row's text into
    the next. Rows with a null document count as occurrences but belong to no record; null
    and word-less texts add nothing. Repeated rows count as often as they come. Extra
    columns are ignored; an empty table has no n-grams.
    """
    wanted = None if sizes is None else tuple(sorted(set(sizes)))
    rows = df.where(F.length(df[text_col]) > 0).select(df[doc_col].cast("string").alias("doc"), df[text_col].alias("text"), F.xxhash64(df[id_col], df[text_col]).alias("h"))
    large = rows.groupBy("doc").count().where(f"count > {ROWS_PER_PART} and doc is not null").select("doc", F.ceil(F.col("count") / ROWS_PER_PART).cast("int").alias("salts"))
    large = materialize(large, "spread-documents")
    # Counted before anything is joined to the texts, so that they are shuffled once, already salted.
    rows = rows.join(F.broadcast(large) if large.count() <= MOST_BROADCAST else large, "doc", "left")
    rows = rows.withColumn("salts", F.coalesce("salts", F.when(F.col("doc").isNull(), F.lit(1 << 20)), F.lit(1)))
    rows = rows.withColumn("salt", F.when(F.col("salts") > 1, F.pmod("h", "salts")).otherwise(F.lit(0)).cast("int"))
    rows = rows.repartition("doc", "salt").sortWithinPartitions("doc", "salt").select("text", "doc", "salts")
    counts = rows.mapInPandas(_blocks(wanted), _GRAM)
    per_part = counts.groupBy("gram", "n", "part").agg(
        F.sum("occurrences").alias("occurrences"), F.when(F.col("part").isNull(), F.sum("records")).otherwise(F.lit(1)).alias("records")
    )
    return per_part.groupBy("gram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, doc_col: str = "doc_id", text_col: str = "text", rare_below: int = 3, common_above: float = 0.25, sizes: Iterable[int] | None = (1,)) -> DataFrame:
    """:func:`ngram_counts` with ``mark``: an array holding ``rare``, ``common``, both or neither."""
    total = df.agg(F.count_distinct(doc_col)).first()[0]
    rare, common = F.when(F.col("records") < rare_below, F.lit("rare")), F.when(F.col("records") > common_above * total, F.lit("common"))
    return ngram_counts(df, doc_col, text_col, sizes=sizes).withColumn("mark", F.array_compact(F.array(rare, common)))
