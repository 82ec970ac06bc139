"""A subject index labelled by a model the caller injects: each distinct text once, resumable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.functions.prompts import json_object
from granary.operators import ordered

MAX_CHARS, MAX_WORDS = 180_000, 8
#: What a labeller is asked.
SYSTEM = 'Name the subjects of the numbered passages. Answer with a JSON object {"subjects": [{"first": n, "last": n, "words": ["..."]}]}.'


def distinct_documents(chunks: DataFrame) -> DataFrame:
    """``(primary, doc_ids, chunk_ids, texts)``: documents whose chunks read the same are one; a titled one stands for them.

    A document is what a labeller reads as a whole, so its chunks are gathered; documents beyond ``MAX_CHARS`` are cut into slices afterwards.
    """
    rows = chunks.where("text is not null").select("doc_id", "source_file", "doc_chunk_index", "chunk_id", "text", tx.digest(F.col("text")).alias("digest"))
    at = F.struct(F.coalesce("doc_chunk_index", F.lit(0)).alias("i"), "chunk_id", "digest", "text")
    # What a document reads as is known by sums over its passages, each with its place: no text is gathered to compare documents.
    place = ordered.around(rows).select("chunk_id", "position")
    placed = rows.drop("text").join(place, "chunk_id")
    mark = lambda seed: F.sum(F.shiftright(F.xxhash64(F.lit(seed), "position", "digest"), 24))
    docs = placed.groupBy("doc_id").agg(F.struct(F.count("*"), mark(1), mark(2), mark(3)).alias("key"), F.min("source_file").alias("source"))
    docs = docs.withColumn("rank", F.struct((~tx.human_source(F.col("source"))).alias("h"), "source", "doc_id"))
    ids = docs.groupBy("key").agg(F.min_by("doc_id", "rank").alias("primary"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    chosen = rows.join(ids.select(F.col("primary").alias("doc_id")), "doc_id", "left_semi")
    first = chosen.groupBy("doc_id").agg(F.array_sort(F.collect_list(at)).alias("c"))
    first = first.select("doc_id", F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"), F.transform("c", lambda x: x["text"]).alias("texts"))
    return ids.join(first, ids["primary"] == first["doc_id"]).select("primary", "doc_ids", "chunk_ids", "texts")


def slices(texts: list[str], most: int = MAX_CHARS) -> list[tuple[int, int]]:
    """Runs of passages of at most ``most`` characters; a longer passage is a slice of its own."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            out.append((start, i))
            start, size = i, 0
        size += len(t)
    return [*out, (start, len(texts))] if texts else []


def calls(sizes: list[int], most_chars: int = MAX_CHARS, most_docs: int = 8) -> list[list[int]]:
    """Positions of consecutive documents that go into one call: at most ``most_docs`` of them and ``most_chars`` characters."""
    out: list[list[int]] = []
    room = 0
    for i, n in enumerate(sizes):
        if not out or len(out[-1]) == most_docs or n > room:
            out.append([])
            room = most_chars
        out[-1].append(i)
        room -= n
    return out


def subjects(payload: dict | None, first: int, last: int) -> list[tuple[int, int, tuple[str, ...]]]:
    """``(first, last, words)`` read from a model's answer; spans outside of what it was shown are dropped."""
    out = []
    for s in (payload or {}).get("subjects") or []:
        if not isinstance(s, dict):
            continue
        try:
            a, b = int(s.get("first")), int(s.get("last", s.get("first")))
        except (TypeError, ValueError):
            continue
        given = s.get("words")
        words = [given] if isinstance(given, str) else given if isinstance(given, list) else []
        words = [" ".join(str(w).split()) for w in words if isinstance(w, (str, int, float)) and str(w).strip()]
        if first <= a <= b <= last and words:
            out.append((a, b, tuple(dict.fromkeys(words))[:MAX_WORDS]))
    return out


def merged(found: list[tuple[int, int, tuple[str, ...]]]) -> list[tuple[int, int, tuple[str, ...]]]:
    """Subjects with the same words (in any case) whose spans touch or overlap are one; in order of their first passage."""
    table = pd.DataFrame(found, columns=["first", "last", "words"])
    if not len(table):
        return []
    table["key"] = [tuple(w.casefold() for w in words) for words in table["words"]]
    table = table.sort_values(["first", "last"], kind="stable")
    # Within one key a span opens a new subject where all before it end more than one passage earlier.
    reach = table.groupby("key", sort=False)["last"].cummax().groupby(table["key"], sort=False).shift()
    table["run"] = (~(table["first"] <= reach + 1)).groupby(table["key"], sort=False).cumsum()
    runs = table.groupby(["key", "run"], sort=False).agg(first=("first", "min"), last=("last", "max"), words=("words", "first"))
    return [(int(a), int(b), w) for a, b, w in runs.sort_values(["first", "last"], kind="stable").itertuples(index=False)]


def build(chunks: DataFrame, path: str, label: Callable[[str, str], tuple[str, int, int]], limit: int | None = None) -> DataFrame:
    """Label the documents that ``path`` has no result of yet and append theirs; returns all results.

    ``label(system, prompt) -> (text, input tokens, output tokens)`` runs in the tasks, for several small documents at once; if a call of several fails, each goes alone. A document whose label fails is
    recorded with its error and tried again by the next call. Result: ``primary, doc_ids, subjects, input_tokens, output_tokens, error``.
    """
    spark = chunks.sparkSession
    docs = distinct_documents(chunks)
    done = _results(spark, path)
    if done is not None:
        docs = docs.join(done.where("error is null").select("primary"), "primary", "left_anti")
    if limit is not None:
        docs = docs.orderBy("primary").limit(limit)

    def ask(pieces: list[tuple[int, list[str], int, int]]) -> tuple[list[list], int, int]:
        """Subjects of each piece ``(document, texts, first, end)`` by one call, passages numbered through; and the tokens spent."""
        shown = [t for _, texts, a, z in pieces for t in texts[a:z]]
        said, i, o = label(SYSTEM, "\n\n".join(f"[{k + 1}] {t}" for k, t in enumerate(shown)))
        answer, out, before = json_object(said), [], 0
        for _, _, a, z in pieces:
            shift = a - before  # from the numbers in the call to those in the document
            out.append([(x + shift, y + shift, w) for x, y, w in subjects(answer, before + 1, before + z - a)])
            before += z - a
        return out, i, o

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            documents = [list(t) for t in b["texts"]]
            pieces = [(d, texts, a, z) for d, texts in enumerate(documents) for a, z in slices(texts)]
            found: list[list] = [[] for _ in documents]
            spent, errors = [[0, 0] for _ in documents], [None] * len(documents)

            def take(group: list, found=found, spent=spent) -> None:
                said, i, o = ask(group)
                spent[group[0][0]] = [spent[group[0][0]][0] + i, spent[group[0][0]][1] + o]  # a call's tokens are booked on its first document
                for piece, subs in zip(group, said):
                    found[piece[0]] += subs

            for at in calls([sum(map(len, texts[a:z])) for _, texts, a, z in pieces]):
                group = [pieces[k] for k in at]
                try:
                    take(group)
                except Exception:  # noqa: BLE001  one document must not fail its neighbours: each piece by itself
                    for piece in group:
                        try:
                            take([piece])
                        except Exception as e:  # noqa: BLE001
                            errors[piece[0]] = f"{type(e).__name__}: {e}"
            rows = []
            for d, (primary, ids, chunk_ids) in enumerate(zip(b["primary"], b["doc_ids"], b["chunk_ids"])):
                subs = [{"words": list(w), "chunk_ids": [chunk_ids[k - 1] for k in range(x, y + 1)]} for x, y, w in merged(found[d])]
                rows.append((primary, list(ids), subs, *spent[d], errors[d]))
            yield pd.DataFrame(rows, columns=["primary", "doc_ids", "subjects", "input_tokens", "output_tokens", "error"])

    kind = "primary string, doc_ids array<string>, subjects array<struct<words:array<string>,chunk_ids:array<string>>>, input_tokens long, output_tokens long, error string"
    docs.mapInPandas(run, kind).write.mode("append").parquet(path)
    return _results(spark, path)


def _results(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        rows = spark.read.parquet(path)
    except Exception:  # noqa: BLE001  nothing has been written yet
        return None
    good = rows.where("error is null")
    return good.unionByName(rows.where("error is not null").join(good.select("primary"), "primary", "left_anti")).dropDuplicates(["primary"])


def find(results: DataFrame, needle: str) -> DataFrame:
    """``(primary, words, chunk_ids)`` of subjects one of whose words contains ``needle`` in any case."""
    rows = results.select("primary", F.explode("subjects").alias("s")).select("primary", "s.words", "s.chunk_ids")
    return rows.where(F.exists("words", lambda w: F.contains(F.lower(w), F.lit(needle.lower()))))




def render(results: DataFrame) -> Iterator[str]:
    """Lines of a Markdown index of subjects by their first word, streamed in order."""
    rows = results.select("primary", F.explode("subjects").alias("s")).select(F.explode("s.words").alias("word"), "primary", F.size("s.chunk_ids").alias("n"))
    last = None
    for word, primary, n in rows.orderBy(F.lower("word"), "word", "primary").toLocalIterator():
        if word != last:
            yield f"- **{word}**"
            last = word
        yield f"  - {primary} ({n})"
