"""Inverted index with positions, and ranked full-text matching over it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.errors import SearchIndexError
from granary.functions.text import search_tokens

PLAIN, SOURCE = 0, 1
K1, B = 1.2, 0.75


def postings(chunks: DataFrame, text_col: str = "plain", source_col: str = "source") -> DataFrame:
    """``(token, chunk_id, col, positions)``: one row per distinct token of a chunk's text (0) or source name (1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for chunk, *texts in zip(b["chunk_id"], b["text"], b["source"]):
                for col, text in enumerate(texts):
                    where: dict[str, list[int]] = {}
                    for i, t in enumerate(search_tokens(text) if text else ()):
                        where.setdefault(t, []).append(i)
                    rows += [(t, chunk, col, p) for t, p in where.items()]
            yield pd.DataFrame(rows, columns=["token", "chunk_id", "col", "positions"])

    base = chunks.select("chunk_id", F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    return base.mapInPandas(run, "token string, chunk_id string, col int, positions array<int>")


def lengths(posts: DataFrame) -> DataFrame:
    """``(chunk_id, size)``: tokens of both columns."""
    return posts.groupBy("chunk_id").agg(F.sum(F.size("positions")).alias("size"))


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens; with ``prefix`` the last need only begin so."""

    tokens: tuple[str, ...]
    prefix: bool = False

    @classmethod
    def of(cls, text: str) -> Phrase:
        found = tuple(search_tokens(text))
        if not found:
            raise SearchIndexError(f"no word to search for in {text!r}")
        return cls(found, text.rstrip().endswith("*"))

    @property
    def key(self) -> str:
        return " ".join(self.tokens) + ("*" if self.prefix else "")


@dataclass(frozen=True)
class Near:
    """Phrases with at most ``distance`` tokens between the end of the first and the start of the last."""

    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass
class Expression:
    """``all`` and at least one of each group of ``any`` and no ``not_``; phrases or :class:`Near`."""

    all: list[Phrase | Near] = field(default_factory=list)
    any: list[list[Phrase]] = field(default_factory=list)
    not_: list[Phrase] = field(default_factory=list)

    def scored(self) -> list[Phrase | Near]:
        return [*self.all, *[p for g in self.any for p in g]]

    def phrases(self) -> list[Phrase]:
        return [p for x in self.scored() + self.not_ for p in (x.phrases if isinstance(x, Near) else (x,))]


def _starts(phrase: Phrase, token: Column, positions: Column) -> Column:
    """Aggregate: per chunk the sorted starts of a phrase, from the positions of its tokens."""
    parts = []
    for i, t in enumerate(phrase.tokens):
        hit = token.startswith(t) if phrase.prefix and i == len(phrase.tokens) - 1 else token == t
        parts.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(hit, positions))))))
    return F.array(*parts)


def counted(posts: DataFrame, expression: Expression, titles: bool = False) -> DataFrame:
    """``(chunk_id, f, hit)`` of the chunks with any token asked for: ``f`` the instances per scored phrase, ``hit`` whether the chunk matches.

    Only the postings of the tokens asked for are read.
    """
    wanted = expression.phrases()
    exact = sorted({t for p in wanted for t in (p.tokens[:-1] if p.prefix else p.tokens)})
    begins = sorted({p.tokens[-1] for p in wanted if p.prefix})
    token = F.col("token")
    tests = ([token.isin(exact)] if exact else []) + [token.startswith(t) for t in begins]
    if not tests:
        raise SearchIndexError("nothing to search for")
    rows = posts.where(reduce(or_, tests))
    if not titles:
        rows = rows.where(F.col("col") == PLAIN)
    # Source positions are kept apart, so that no phrase runs from one column into the other.
    shifted = F.transform("positions", lambda p: p + F.col("col") * (1 << 28))
    by = {p.key: p for p in wanted}
    keys = list(by)
    grouped = rows.groupBy("chunk_id").agg(*[_starts(by[k], token, shifted).alias(f"t{i}") for i, k in enumerate(keys)])

    def starts(i: int) -> Column:
        size = len(by[keys[i]].tokens)
        found = F.col(f"t{i}")[0]
        for j in range(1, size):
            found = _following(found, F.col(f"t{i}")[j], j)
        return found

    grouped = grouped.select("chunk_id", *[starts(i).alias(f"p{i}") for i in range(len(keys))])
    place = {k: i for i, k in enumerate(keys)}
    frequency: list[Column] = []

    def instances(x: Phrase | Near) -> list[Column]:
        if isinstance(x, Phrase):
            return [F.size(f"p{place[x.key]}")]
        return _near(x, [F.col(f"p{place[p.key]}") for p in x.phrases])

    tests = []
    for x in expression.all:
        f = instances(x)
        frequency += f
        tests += [c > 0 for c in f]
    for group in expression.any:
        f = [c for p in group for c in instances(p)]
        frequency += f
        tests.append(reduce(or_, [c > 0 for c in f]))
    for p in expression.not_:
        tests.append(instances(p)[0] == 0)
    f = F.array(*[c.cast("double") for c in frequency]) if frequency else F.array().cast("array<double>")
    return grouped.select("chunk_id", f.alias("f"), (reduce(and_, tests) if tests else F.lit(True)).alias("hit"))


def hits(counted_: DataFrame) -> DataFrame:
    """``(chunk_id, f)`` of the chunks that match."""
    return counted_.where("hit").select("chunk_id", "f")


def statistics(counted_: DataFrame) -> list[int]:
    """Chunks per scored phrase, whether they match or not."""
    rows = counted_.select(F.posexplode("f").alias("i", "f")).groupBy("i").agg(F.count_if(F.col("f") > 0)).orderBy("i").collect()  # one row per phrase
    return [r[1] for r in rows]


def _following(starts: Column, later: Column, by: int) -> Column:
    return F.filter(starts, lambda p: F.array_contains(later, p + by))


def _near(near: Near, starts: list[Column]) -> list[Column]:
    """Instances of each phrase that lie in some window holding them all."""
    sizes = [len(p.tokens) for p in near.phrases]
    windows = []
    for first, size in zip(starts, sizes):
        windows.append(F.transform(F.filter(first, _complete(starts, size + near.distance)), _pair(size + near.distance)))
    spans = F.flatten(F.array(*windows))
    return [F.size(F.filter(s, _in_some(spans))) for s in starts]


def _within(s: Column, reach: int):
    return lambda p: (p >= s) & (p <= s + reach)


def _complete(starts: list[Column], reach: int):
    return lambda s: reduce(and_, [F.exists(other, _within(s, reach)) for other in starts])


def _pair(reach: int):
    return lambda s: F.struct(s.alias("a"), (s + reach).alias("b"))


def _in_some(spans: Column):
    return lambda x: F.exists(spans, lambda w: (x >= w["a"]) & (x <= w["b"]))


def bm25(hits_: DataFrame, stats: list[int], sizes: DataFrame, rows: int, mean: float) -> DataFrame:
    """``(chunk_id, score)``: BM25 over the whole index's statistics, rounded to 4 digits.

    ``stats``: chunks per scored phrase; ``rows`` and ``mean``: number and mean size of all chunks.
    """
    import math

    # A phrase in more than half of all rows would count against a row: it counts almost nothing instead.
    idf = [x if (x := math.log((rows - n + 0.5) / (n + 0.5))) > 0 else 1e-6 for n in stats]
    norm = F.lit(K1) * (1 - B + B * F.col("size") / F.lit(float(mean)))
    score = reduce(lambda a, b: a + b, [F.lit(w) * F.col("f")[i] * (K1 + 1) / (F.col("f")[i] + norm) for i, w in enumerate(idf)], F.lit(0.0))
    return hits_.join(sizes, "chunk_id").select("chunk_id", F.round(score, 4).alias("score"))
