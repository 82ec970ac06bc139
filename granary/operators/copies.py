"""Groups of identical, nearly identical and overlapping chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.session import materialize

#: Words of a shingle; shares of the smaller chunk for a pair and of the larger one for a group; fewest words.
WIDTH, CONTAINMENT, GROUP_LARGER, MIN_WORDS = 5, 0.8, 0.5, 30


def keys(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, identical_key, near_key)``; the near key is null where a text has no word."""
    near = tx.near_key("text")
    return chunks.where("text is not null and chunk_id is not null").select(
        "chunk_id", F.sha2(tx.collapsed(F.col("text")), 256).alias("identical_key"), near.alias("near_text")
    )


def _numbered(groups: DataFrame, letter: str) -> DataFrame:
    """``group_id`` from the smallest member: stable under any partitioning, found without a global sort."""
    return groups.withColumn("group_id", F.concat(F.lit(letter), F.substring(F.sha2("rep", 256), 1, 15)))


def identical_groups(chunks: DataFrame) -> DataFrame:
    """``(group_id, kind, chunk_id)`` of chunks whose texts are equal up to blanks. Group ids derive from the smallest member."""
    k = chunks.where("text is not null and chunk_id is not null").select("chunk_id", F.sha2(tx.collapsed(F.col("text")), 256).alias("key")).distinct()
    groups = k.groupBy("key").agg(F.min("chunk_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    return k.join(_numbered(groups, "I"), "key").select("group_id", F.lit("identical").alias("kind"), "chunk_id")


def near_table(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, identical_key, near_hash, near_text, copy_rep)``; ``copy_rep`` is the smallest chunk with the same words.

    Chunks without a word are nobody's copy: they represent themselves.
    """
    k = keys(chunks).withColumn("near_hash", F.when(F.col("near_text") != "", F.sha2("near_text", 256)))
    k = materialize(k, "copy-keys")
    reps = k.where("near_hash is not null").groupBy("near_hash").agg(F.min("chunk_id").alias("rep"), F.count_distinct("identical_key").alias("variants"))
    return k.join(reps, "near_hash", "left").withColumn("copy_rep", F.coalesce("rep", "chunk_id"))


def near_groups(near: DataFrame) -> DataFrame:
    """``(group_id, kind, chunk_id)`` of chunks with the same words but not all the same text."""
    rows = near.where("variants > 1").select("rep", "chunk_id").distinct()
    return _numbered(rows, "N").select("group_id", F.lit("near").alias("kind"), "chunk_id")


def overlap_pairs(near: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``(chunk_a, chunk_b, shared_shingles, containment, containment_larger)``: all overlapping pairs of representatives.

    Exact: a chunk that has a share of ``containment`` of its shingles in a larger one has at
    least one of its rarest ``n - ceil(containment * n) + 1`` there, so only those look for
    partners, among all shingles of the larger chunks. Frequent shingles hardly ever are among
    a chunk's rarest, so no posting has to be capped and no candidate is lost. Copies are
    represented by their smallest id; membership is in :func:`near_table`. Chunks with fewer than
    ``min_words`` words take no part.
    """
    words = F.split("near_text", " ")
    reps = near.where("chunk_id = copy_rep and near_hash is not null").where(F.size(words) >= min_words).dropDuplicates(["chunk_id"])
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - (width - 1)), lambda i: F.xxhash64(F.array_join(F.slice("words", i, F.lit(width)), " ")))
    reps = reps.select("chunk_id", words.alias("words")).where(F.size("words") >= width).select("chunk_id", F.array_distinct(runs).alias("shingles"))
    reps = materialize(reps.withColumn("size", F.size("shingles")), "shingles")
    posts = reps.select("chunk_id", "size", F.explode("shingles").alias("h"))
    frequency = posts.groupBy("h").agg(F.count("*").alias("df"))
    rare = posts.join(frequency.where("df > 1"), "h")  # a shingle of one chunk links nothing
    rare = materialize(rare, "shared-shingles")
    # Of its rarest shingles those that no other chunk has count as looked up already.
    prefix = F.col("size") - F.ceil(F.lit(containment) * F.col("size")) + 1
    shared = rare.groupBy("chunk_id", "size").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))  # one chunk's shingles
    look = shared.withColumn("take", prefix - (F.col("size") - F.size("s"))).where("take > 0")
    look = look.select(F.col("chunk_id").alias("small"), F.col("size").alias("small_size"), F.explode(F.slice("s", F.lit(1), F.col("take").cast("int"))).alias("x"))
    look = look.select("small", "small_size", F.col("x.h").alias("h"))
    large = rare.select(F.col("chunk_id").alias("large"), F.col("size").alias("large_size"), "h")
    later = (F.col("large_size") > F.col("small_size")) | ((F.col("large_size") == F.col("small_size")) & (F.col("large") > F.col("small")))
    candidates = look.join(large, "h").where(later).select("small", "large").distinct()
    full = candidates.join(reps.select(F.col("chunk_id").alias("small"), F.col("shingles").alias("sa"), F.col("size").alias("na")), "small")
    full = full.join(reps.select(F.col("chunk_id").alias("large"), F.col("shingles").alias("sb"), F.col("size").alias("nb")), "large")
    n = F.size(F.array_intersect("sa", "sb"))
    full = full.select(F.least("small", "large").alias("chunk_a"), F.greatest("small", "large").alias("chunk_b"), n.alias("shared_shingles"), "na", "nb")
    n = F.col("shared_shingles")
    full = full.where(n >= containment * F.least("na", "nb"))
    return full.select("chunk_a", "chunk_b", "shared_shingles", F.round(n / F.least("na", "nb"), 4).alias("containment"), F.round(n / F.greatest("na", "nb"), 4).alias("containment_larger"))


def components(pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """``(node, root)`` with the smallest node of each connected component.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm
    of a component's size, not its diameter. Every round is written to the shared folder.
    Self-pairs and null ends are ignored. Groups that are not complete after ``rounds`` raise an error.
    """
    edges = pairs.select(F.col(pairs.columns[0]).alias("u"), F.col(pairs.columns[1]).alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    for _ in range(rounds):
        # Large star: a node's larger neighbours link to the smallest of its neighbourhood.
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours link to the smallest of them.
        down = large.where("u > v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "edges")
        marks = [e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first() for e in (edges, new)]
        edges = new
        if marks[0] == marks[1]:
            break
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def overlap_groups(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """``(group_id, kind, chunk_id)``: components of pairs that share half of the larger chunk, near copies included."""
    linked = components(pairs.where(F.col("containment_larger") >= GROUP_LARGER).select("chunk_a", "chunk_b"))
    rows = near.select("chunk_id", "copy_rep").distinct().join(linked.select(F.col("node").alias("copy_rep"), F.col("root").alias("rep")), "copy_rep")
    return _numbered(rows, "O").select("group_id", F.lit("overlap").alias("kind"), "chunk_id")


def copy_groups(chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """All groups: ``(group_id, kind, chunk_id)``."""
    near = near_table(chunks)
    return identical_groups(chunks).unionByName(near_groups(near)).unionByName(overlap_groups(overlap_pairs(near, width), near))
