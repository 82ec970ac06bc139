"""Vector retrieval, ranking rules, returned items, and prompt blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.errors import RetrievalModeError
from granary.session import materialize

MODES = ("scored", "ordered", "complete_set")
DEFAULT_DEPTH = 5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a length differs or a vector is all zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def depth(asked: int | None, configured: int | None = None) -> int:
    """How many rows a query returns: the call's depth, else the connection's, else 5."""
    k = asked if asked is not None else configured if configured is not None else DEFAULT_DEPTH
    if k < 1:
        raise RetrievalModeError("top_k is positive")
    return k


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_bytes: int = 64 << 20) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` vectors of greatest cosine for each stated query, exactly.

    Queries ``(query_id, vector)`` are taken in blocks of at most ``query_bytes`` of numbers, which travel with one pass over the
    vectors; no more than a block is ever on the driver beside its pass. A task keeps the best k per query over all its
    rows, and only those are shuffled. Ties go to the smaller id.
    """
    import numpy as np
    import pandas as pd

    kind, qkind = dict(vectors.dtypes)[id_col], dict(queries.dtypes)["query_id"]
    schema = f"query_id {qkind}, id {kind}, score double"
    base = vectors.where(f"{vector_col} is not null").select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))

    def scorer(rows: list):
        sizes: dict[int, tuple[list, np.ndarray]] = {}
        for n in {len(r["vector"]) for r in rows}:
            these = [r for r in rows if len(r["vector"]) == n]
            x = np.array([r["vector"] for r in these], np.float64).reshape(len(these), n)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            sizes[n] = [r["query_id"] for r in these], np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)

        def score(batches):
            best: dict[int, pd.DataFrame] = {}
            for b in batches:
                length = b["v"].map(len).to_numpy()
                for n, (ids, x) in sizes.items():
                    fit = b["id"][length == n].to_numpy()
                    if not len(fit):
                        continue
                    m = np.stack([np.asarray(v, np.float64) for v in b["v"][length == n]])
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    m = np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)
                    for at in range(0, len(ids), 256):  # scores of a block of queries at a time
                        s = (m @ x[at : at + 256].T).T
                        # All that reach the k-th score go on, equal ones too; the sort below decides by id.
                        s = np.where(np.isnan(s), -np.inf, s)
                        least = np.partition(s, -min(k, s.shape[1]), 1)[:, -min(k, s.shape[1])] - 1e-12
                        q, i = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                        new = pd.DataFrame({"q": q + at, "id": fit[i], "score": s[q, i]})
                        old = best.get((n, at))
                        new = new if old is None else pd.concat([old, new])
                        new["r"] = new["score"].round(12)
                        best[n, at] = new.sort_values(["q", "r", "id"], ascending=[True, False, True]).groupby("q").head(k).drop(columns="r")
            for (n, _), found in best.items():
                ids = sizes[n][0]
                yield pd.DataFrame({"query_id": [ids[q] for q in found["q"]], "id": found["id"], "score": found["score"]})

        return score

    parts, block, held = [], [], 0
    for row in queries.where("vector is not null").select("query_id", "vector").toLocalIterator():
        block.append(row)
        held += 8 * len(row["vector"])
        if held >= query_bytes:
            parts.append(materialize(base.mapInPandas(scorer(block), schema), "topk"))
            block, held = [], 0
    if block or not parts:
        parts.append(base.mapInPandas(scorer(block), schema))
    out = reduce(DataFrame.unionByName, parts)
    place = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id")
    return out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def resolve_mode(live: str, override: str | None = None) -> str:
    """The mode in force. Only scored results may be declared merely ordered."""
    if live not in MODES:
        raise RetrievalModeError(f"unknown retrieval mode {live!r}")
    if override in (None, live):
        return live
    if (live, override) == ("scored", "ordered"):
        return override
    raise RetrievalModeError(f"a {live} result cannot be declared {override}")


def apply_threshold(hits: DataFrame, mode: str, least: float | None) -> DataFrame:
    """Rows scored at least ``least``; thresholds make sense for scored results only."""
    if least is None:
        return hits
    if mode != "scored":
        raise RetrievalModeError(f"no threshold applies to {mode} results")
    return hits.where(F.col("score") >= least)


#: Distances and inner products to scores where more is better (see the connector contract).
SCORES = {"cosine_distance": lambda d: 1 - d, "l2": lambda d: -d, "similarity": lambda s: s}


def ranking_basis(rows: DataFrame, mode: str) -> DataFrame:
    """``(query_id, status, ranked_ids, returned_ids, context_rows, unscored_match_rows)`` of returned rows.

    ``rows``: ``query_id, rank, chunk_id, score, role, origin``; ``rank`` is the place as returned. Context
    rows are never ranked. A result is one caller's page, so its rows fit an array.
    """
    if mode not in MODES:
        raise RetrievalModeError(f"unknown retrieval mode {mode!r}")
    context = F.coalesce(F.col("role") == "context", F.lit(False))
    row = F.struct("rank", "chunk_id", "score", context.alias("context"))
    per = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    match = F.filter("r", lambda x: ~x["context"])
    scored = F.filter(match, lambda x: x["score"].isNotNull())
    some, all_ = F.size(scored), F.size(match)
    if mode == "scored":
        status = F.when(all_ == 0, "not_applicable").when(some < all_, "error").otherwise("scores")
    elif mode == "ordered":
        status = F.when(all_ == 0, "not_applicable").otherwise("returned_order")
    else:
        status = F.when(some == 0, "not_applicable").otherwise("scores")
    by_score = F.array_sort(F.transform(scored, lambda x: F.struct((-x["score"]).alias("s"), x["rank"].alias("rank"), x["chunk_id"].alias("chunk_id"))))
    ids = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: x["chunk_id"]), lambda x: x.isNotNull()))
    none = F.array().cast("array<string>")
    ranked = F.when(F.col("status") == "scores", ids(by_score)).when(F.col("status") == "returned_order", ids(match)).otherwise(none)
    per = per.withColumn("status", status)
    return per.select(
        "query_id", "status", ranked.alias("ranked_ids"), ids(F.col("r")).alias("returned_ids"), (F.size("r") - all_).alias("context_rows"), (all_ - some).alias("unscored_match_rows"),
    )


def context_by_origin(rows: DataFrame) -> DataFrame:
    """``(query_id, origin, chunk_ids)`` of context rows, in order of return."""
    context = rows.where("role = 'context'").withColumn("origin", F.coalesce("origin", F.lit("unlabelled")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])
    return context.groupBy("query_id", "origin").agg(F.array_distinct(ids).alias("chunk_ids"))


KINDS = ("chunk", "passage", "summary", "gap")


def with_item_defaults(rows: DataFrame) -> DataFrame:
    """Rows with ``kind`` (older spellings replaced, default by what is covered) and ``credited``, the chunks a row stands for."""
    kind = F.when(F.col("item_kind") == "group", "summary").otherwise(F.col("item_kind"))
    kind = F.coalesce(kind, F.when(F.col("item_covered_ids").isNotNull(), "summary").otherwise("chunk"))
    own = F.when(F.col("chunk_id").isNotNull(), F.array("chunk_id")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("kind", kind).withColumn("credited", F.coalesce("item_covered_ids", own))


def item_problems(rows: DataFrame) -> DataFrame:
    """``(query_id, rank, problems)`` of rows whose item declaration breaks a rule."""
    r = with_item_defaults(rows)
    kind, covered, role = F.col("kind"), F.col("item_covered_ids"), F.col("item_role")
    itself = F.coalesce(covered == F.array("chunk_id"), F.lit(False))
    rules = [
        ("covered ids are empty or null", F.exists(covered, lambda x: x.isNull() | (x == ""))),
        ("a covered id is repeated", F.size(covered) != F.size(F.array_distinct(covered))),
        ("unknown kind", ~kind.isin(*KINDS)),
        ("a gap covers nothing", (kind == "gap") & (F.size(covered) > 0)),
        ("a chunk or passage has an id", kind.isin("chunk", "passage") & F.col("chunk_id").isNull()),
        ("a chunk or passage covers itself", kind.isin("chunk", "passage") & covered.isNotNull() & ~itself),
        ("a passage has an index", (kind == "passage") & F.col("item_index").isNull()),
        ("unknown role", role.isNotNull() & ~role.isin("match", "context")),
        ("a context row has no score", (role == "context") & F.col("score").isNotNull()),
        ("a gap has no role", (kind == "gap") & role.isNotNull()),
        ("an origin labels context rows", F.col("item_origin").isNotNull() & ((F.trim("item_origin") == "") | ~F.coalesce(role == "context", F.lit(False)))),
        ("an index is not negative", F.col("item_index") < 0),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules]))
    return r.select("query_id", "rank", found.alias("problems")).where(F.size("problems") > 0)


def items(rows: DataFrame) -> DataFrame:
    """``(query_id, item_rank, kind, covered_ids, row_ranks, score, has_match)``: rows that share an index are one item.

    Items stand in the order of their first row. A passage covers the union of its rows in order;
    other items what their first row covers. The score is the best of the match rows.
    """
    r = with_item_defaults(rows).withColumn("item", F.coalesce(F.concat(F.lit("i"), F.col("item_index")), F.concat(F.lit("r"), F.col("rank"))))
    is_match = F.coalesce(F.col("item_role") == "match", F.lit(True)) & (F.col("kind") != "gap")
    row = F.struct("rank", "kind", "credited")
    per = r.groupBy("query_id", "item").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.max(F.when(is_match, F.col("score"))).alias("score"), F.bool_or(is_match).alias("has_match"), F.min("rank").alias("first"),
    )
    kind = F.col("rows")[0]["kind"]
    union = F.array_distinct(F.flatten(F.transform("rows", lambda x: x["credited"])))
    covered = F.when(kind == "passage", union).otherwise(F.col("rows")[0]["credited"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    return per.select("query_id", place.alias("item_rank"), kind.alias("kind"), covered.alias("covered_ids"), F.transform("rows", lambda x: x["rank"]).alias("row_ranks"), "score", "has_match")


def rag_blocks(hits: DataFrame, with_ids: bool = True) -> DataFrame:
    """``(query_id, block)``: the texts of each result, numbered from 1 in order of rank, a blank line between."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text")))
    head = lambda x, i: F.concat(F.lit("["), i + 1, F.lit("]"), F.concat(F.lit(" chunk_id="), x["chunk_id"]) if with_ids else F.lit(""), F.lit("\n"), x["text"])
    return hits.groupBy("query_id").agg(F.array_join(F.transform(rows, head), "\n\n").alias("block"))
