"""The k most similar vectors of every vector, from robust-pruned graphs.

Identical vectors are collapsed first, so a vector with many copies is one node. Nodes
are spread over shards by spherical k-means fitted on a bounded sample: each is indexed in
its ``replicas`` nearest shards and queries its ``probes`` nearest. In a shard, greedy searches
on the growing graph propose neighbours, relaxed-distance pruning keeps diverse edges, and
a beam search answers each query. All steps run on batches of nodes at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.operators.retrieval import cosine
from granary.session import materialize

#: Vectors the centroids are fitted on; every vector is indexed and queried.
SAMPLE_ROWS = 20_000
#: Indexed vectors a shard aims at.
SHARD_ROWS = 12_000


class Graph:
    """A directed graph over unit vectors with bounded out-degree, searched by beams."""

    def __init__(self, vectors: np.ndarray, degree: int = 24, beam: int = 40, alpha: float = 1.2, batch: int = 256, passes: int = 2, seed: int = 0):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.degree, self.slack, self.alpha2 = degree, degree + degree // 2, alpha * alpha
        n = len(self.x)
        self.edges = np.full((n, self.slack), -1, np.int32)
        self.out = np.zeros(n, np.int32)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.entries = order[: max(1, min(n, 8))]
        first = min(n, 2 * degree)
        start = order[:first]
        if first > 1:
            self._link(start, np.broadcast_to(start, (first, first)).copy())
        for turn in range(passes):
            at = first if turn == 0 else 0
            while at < n:
                size = min(batch, max(32, at // 8)) if turn == 0 else batch
                nodes = order[at : at + size]
                self._link(nodes, self.search(self.x[nodes], beam)[0])
                at += size

    def search(self, queries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and squared distances of the ``beam`` nearest found for each query, nearest first."""
        b, n = len(queries), len(self.x)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True  # stands for "no node"
        ids = np.full((b, beam), n, np.int64)
        dist = np.full((b, beam), np.inf, np.float32)
        closed = np.zeros((b, beam), bool)
        fresh = np.broadcast_to(self.entries.astype(np.int64), (b, len(self.entries))).copy()
        active = np.arange(b)
        while len(active):
            r = rows[: len(active)]
            q = queries[active]
            known = seen[active[:, None], fresh]
            seen[active[:, None], fresh] = True
            line, column = np.nonzero(~known)
            near = np.full(fresh.shape, np.inf, np.float32)
            near[line, column] = 2 - 2 * np.einsum("ij,ij->i", self.x[fresh[line, column]], q[line])
            all_ids = np.concatenate([ids[active], fresh], 1)
            all_dist = np.concatenate([dist[active], near], 1)
            all_closed = np.concatenate([closed[active], np.zeros(fresh.shape, bool)], 1)
            top = np.argpartition(all_dist, beam - 1, 1)[:, :beam]
            cut = all_dist[r, top]
            cut_ids, cut_closed = all_ids[r, top], all_closed[r, top]
            waiting = np.where(cut_closed, np.inf, cut)
            pick = np.argpartition(waiting, wide - 1, 1)[:, :wide] if beam > wide else np.broadcast_to(np.arange(beam), (len(active), beam))
            chosen = np.isfinite(waiting[r, pick])
            cut_closed[r, pick] = True
            ids[active], dist[active], closed[active] = cut_ids, cut, cut_closed
            go = chosen.any(1)
            if not go.any():
                break
            nodes = np.where(chosen, cut_ids[r, pick], n)[go]
            out = np.full((*nodes.shape, self.slack), n, np.int64)
            real = nodes < n
            out[real] = self.edges[nodes[real]]
            out[out < 0] = n
            fresh = np.sort(out.reshape(len(nodes), -1), 1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
            active = active[go]
        order = np.argsort(dist, 1, kind="stable")
        ids, dist = ids[rows, order], dist[rows, order]
        return np.where(np.isfinite(dist), ids, -1).astype(np.int64), dist

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Per node the nearest candidates none of which is much closer to another kept one; -1 pads."""
        c = candidates.astype(np.int64)
        c = np.sort(np.where(c == nodes[:, None], -1, c), 1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        v = self.x[c]
        dist = 2 - 2 * np.einsum("bcd,bd->bc", v, self.x[nodes])
        dist[c < 0] = np.inf
        width = min(c.shape[1], 2 * self.slack)
        order = np.argsort(dist, 1)[:, :width]
        r = np.arange(len(c))[:, None]
        c, dist, v = c[r, order], dist[r, order], v[r, order]
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = np.isfinite(dist)
        kept = np.zeros(c.shape, bool)
        count = np.zeros(len(c), np.int32)
        for i in range(width):
            take = alive[:, i] & (count < self.degree)
            if not take.any():
                continue
            kept[:, i] = take
            count += take
            alive &= ~(take[:, None] & (self.alpha2 * between[:, i] <= dist))
        out = np.full((len(c), self.slack), -1, np.int32)
        place = np.cumsum(kept, 1) - 1
        line, column = np.nonzero(kept)
        out[line, place[line, column]] = c[line, column]
        return out

    def _link(self, nodes: np.ndarray, found: np.ndarray) -> None:
        new = self._prune(nodes, np.concatenate([found, self.edges[nodes]], 1))
        self.edges[nodes] = new
        self.out[nodes] = (new >= 0).sum(1)
        line, column = np.nonzero(new >= 0)
        source, target = nodes[line], new[line, column]
        # Reverse edges: append while there is room, prune where there is not.
        there = (self.edges[target] == source[:, None]).any(1)
        source, target = source[~there], target[~there]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        starts = np.flatnonzero(np.diff(target, prepend=-1))
        counts = np.diff(np.append(starts, len(target)))
        slot = np.arange(len(target)) - np.repeat(starts, counts)
        free = self.out[target] + slot < self.slack
        self.edges[target[free], self.out[target[free]] + slot[free]] = source[free]
        touched = target[starts]
        full = self.out[touched] + counts > self.slack
        self.out[touched] = np.minimum(self.out[touched] + counts, self.slack)
        if full.any():
            crowded = touched[full]
            extra = np.full((len(crowded), int(counts[full].max())), -1, np.int32)
            for i, (s, k) in enumerate(zip(starts[full], counts[full])):
                extra[i, :k] = source[s : s + k]
            for at in range(0, len(crowded), 1024):
                part = crowded[at : at + 1024]
                new = self._prune(part, np.concatenate([self.edges[part], extra[at : at + 1024]], 1))
                self.edges[part] = new
                self.out[part] = (new >= 0).sum(1)


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids)
    return centroids.astype(np.float32)


def _unit(vectors: pd.Series) -> np.ndarray:
    """Unit vectors in double precision, whatever the size of their numbers."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(
    df: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", dimension: int = 64, k: int = 5,
    shard_rows: int = SHARD_ROWS, replicas: int = 2, probes: int | None = None, degree: int = 24, beam: int = 48, passes: int = 1,
) -> DataFrame:
    """``(id, neighbour, similarity, rank)``: up to ``k`` rows per usable vector, cosine, best first.

    Usable are vectors of ``dimension`` finite numbers, not all zero; repeated rows count
    once. An id with several vectors counts with each, at its best similarity, and is no neighbour of itself. Ties
    (of nine digits) rank by smaller id.
    Fewer than k + 1 usable vectors give fewer neighbours; one or none gives no row. The
    search is approximate: recall against brute force is measured in the tests. Without
    ``probes`` a query searches 2 + log2(shards) shards, as routing gets harder with their number.
    A second building pass (``passes``) raises recall by less than half a percent.
    """
    v = F.col("v")
    usable = df.where(df[id_col].isNotNull()).select(df[id_col].cast("string").alias("id"), df[vector_col].cast("array<float>").alias("v"))
    usable = usable.where((F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    usable = usable.distinct()
    # Of each group of identical vectors at most k + 1 ids are ever neighbours; the limit applies before the shuffle.
    usable = materialize(usable.withColumn("group", F.unhex(F.md5(F.concat_ws(",", v.cast("array<string>"))))), "vectors")
    ranked = usable.withColumn("n", F.row_number().over(Window.partitionBy("group").orderBy("id"))).where(F.col("n") <= k + 1)
    several = not usable.groupBy("id").count().where("count > 1").isEmpty()
    nodes = ranked.groupBy("group").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    nodes = materialize(nodes, "vector-nodes")
    count = nodes.count()
    shards = max(1, math.ceil(count * replicas / shard_rows))
    replicas, probes = min(replicas, shards), min(max(replicas, probes or 2 + math.ceil(math.log2(shards))), shards)
    sample = nodes.orderBy("group").limit(SAMPLE_ROWS).select("v").toPandas()  # groups are hashes: a uniform sample
    if not len(sample):
        return df.sparkSession.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    unit = _unit(sample["v"]).astype(np.float32)
    centroids = fit_centroids(unit, shards)
    # A crowded cell is split into parts, each a graph of its own that the cell's queries all search.
    load = np.bincount(np.argpartition(-(unit @ centroids.T), replicas - 1, 1)[:, :replicas].ravel(), minlength=len(centroids))
    parts = np.maximum(1, np.ceil(load / len(unit) * count / (1.5 * shard_rows))).astype(int)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            scores = _unit(b["v"]).astype(np.float32) @ centroids.T
            best = np.argsort(-scores, 1)[:, :probes]
            spot = b["group"].map(lambda h: int.from_bytes(h[:4], "big")).to_numpy()
            for j in range(best.shape[1]):
                cell = best[:, j]
                for part in range(int(parts[cell].max())):
                    mask = parts[cell] > part
                    yield pd.DataFrame({
                        "cell": cell[mask] * 4096 + part, "member": (j < replicas) & (spot[mask] % parts[cell[mask]] == part),
                        "group": b["group"][mask], "ids": b["ids"][mask], "v": b["v"][mask],
                    })

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["group", "neighbour", "similarity"]
        member = pdf["member"].to_numpy()
        if not member.any():
            return pd.DataFrame(columns=columns)
        x = _unit(pdf["v"])
        own, rough = x[member], x.astype(np.float32)
        ids, groups = pdf["ids"].to_numpy(), pdf["group"].to_numpy()
        member_ids, member_groups = ids[member], groups[member]
        graph = Graph(rough[member], degree, beam, passes=passes)
        out: list[tuple] = []
        for at in range(0, len(x), 512):
            found, _ = graph.search(rough[at : at + 512], beam)
            found = found[:, : k + 1]
            exact = np.einsum("bkd,bd->bk", own[found], x[at : at + 512])
            for i in range(len(found)):
                me = groups[at + i]
                # All ids of each vector found, since equal similarities go by id.
                out += [(me, other, s) for node, s in zip(found[i], exact[i]) if node >= 0 and member_groups[node] != me for other in member_ids[node][: k + 1]]
        return pd.DataFrame(out, columns=columns)

    routed = nodes.mapInPandas(route, "cell int, member boolean, group binary, ids array<string>, v array<float>")
    # One cell is much work in few rows: the planner is not to put several into a task to save tasks.
    cells = int(parts.sum())
    routed = routed.repartition(cells + min(3 * cells, 3000), "cell")
    links = routed.groupBy("cell").applyInPandas(answer, "group binary, neighbour string, similarity double")
    best = links.groupBy("group", "neighbour").agg(F.max("similarity").alias("similarity"))
    order = F.struct((-F.round("similarity", 9)).alias("o"), F.col("neighbour"), F.col("similarity"))
    # At most probes * (k + 1)**2 candidates a group, however many vectors it stands for.
    others = best.groupBy("group").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k + 1).alias("others"))
    near = nodes.select("group", "ids").join(others, "group", "left")
    rows = usable.select("id", "group").join(near, "group")
    copies = F.transform("ids", lambda x: F.struct(F.lit(-1.0).alias("o"), x.alias("neighbour"), F.lit(1.0).alias("similarity")))
    all_ = F.concat(copies, F.coalesce("others", F.array().cast("array<struct<o:double,neighbour:string,similarity:double>>")))
    first = F.slice(F.array_sort(F.filter(all_, lambda x: x["neighbour"] != F.col("id"))), 1, k)
    if several:  # the best of an id's vectors for each neighbour
        rows = rows.select("id", F.explode(first).alias("x")).groupBy("id", "x.neighbour").agg(F.min("x").alias("x"))
        place = F.row_number().over(Window.partitionBy("id").orderBy("x"))
        rows = rows.select("id", "x", place.alias("rank")).where(F.col("rank") <= k)
    else:
        rows = rows.select("id", F.posexplode(first).alias("p", "x")).withColumn("rank", F.col("p") + 1)
    return rows.select("id", F.col("x.neighbour").alias("neighbour"), F.col("x.similarity").alias("similarity"), "rank")


def mutual_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """``(chunk_a, chunk_b)``, smaller id first: each among the other's neighbours, cosine at least ``least``."""
    close = neighbours.where(F.col("similarity") >= least).select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b"))
    return close.groupBy("chunk_a", "chunk_b").count().where("count > 1").select("chunk_a", "chunk_b")


def check(near: DataFrame, df: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """``(rows, vectors, repeated, misjudged)``: neighbours, ids that have some, neighbours given twice, and similarities other than those of the vectors (to six digits)."""
    v = df.select(df[id_col].alias("id"), df[vector_col].cast("array<double>").alias("v")).where("v is not null").distinct()
    near = materialize(near, "neighbours")
    pairs = near.join(v, "id").join(v.select(F.col("id").alias("neighbour"), F.col("v").alias("w")), "neighbour")
    true = pairs.groupBy("id", "neighbour", "similarity").agg(F.max(cosine(F.col("v"), F.col("w"))).alias("true"))
    wrong = true.agg(F.count_if(F.abs(F.col("true") - F.col("similarity")) > 1e-6).alias("misjudged"))
    one = near.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("vectors"), (F.count("*") - F.count_distinct("id", "neighbour")).alias("repeated"))
    (rows, vectors, repeated), (misjudged,) = one.first(), wrong.first()
    return near.sparkSession.createDataFrame([(rows, vectors, repeated, misjudged)], "rows long, vectors long, repeated long, misjudged long")
