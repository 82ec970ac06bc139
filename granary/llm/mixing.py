"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a keyed hash and queue up; a document's virtual
finish time is the tokens its source has queued up to it, divided by the source's target
weight. The documents of a mix are sorted by it over all partitions and cut off where their running
total reaches the budget, so every prefix of the mix has the target shares. Repeats queue behind all
documents of their source.

Running totals need no pass over a source or a mix in one task: the hash space is cut into buckets and the
sorted mix into ranges, whose totals are summed first; only a bucket or range is ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.tokens import VOCABULARY, token_sizes
from granary.session import materialize

#: Documents ordered together in one task.
BUCKET_ROWS = 50_000


def queue(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", vocabulary: str = VOCABULARY, seed: int = 0) -> DataFrame:
    """``(source, doc_id, tokens, queued, source_tokens)``: shuffled queues of the sources.

    ``queued`` is the sum of the tokens of the source's documents up to and with this one.
    Documents without a source or without a token are in no queue.
    """
    sizes = token_sizes(docs.where(docs[source_col].isNotNull()), [id_col, source_col], text_col, vocabulary)
    return materialize(queue_sizes(sizes.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "tokens"), seed), "queues")


def queue_sizes(sizes: DataFrame, seed: int = 0) -> DataFrame:
    """:func:`queue` for ``(id, source, tokens)``."""
    sizes = materialize(sizes.where("tokens > 0 and source is not null").withColumn("place", F.xxhash64(F.lit(seed), "id")), "mix-sizes")
    bits = max(0, math.ceil(math.log2(max(1, sizes.count() / BUCKET_ROWS))))
    bucket = F.shiftrightunsigned("place", 64 - bits) if bits else F.lit(0).cast("long")
    sizes = sizes.withColumn("bucket", bucket)
    totals = sizes.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("n").over(Window.partitionBy("source"))
    totals = totals.select("source", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"), whole.alias("source_tokens"))
    # Unsigned order within a bucket; equal places (repeated ids) go by id and size.
    order = [F.shiftrightunsigned("place", 1), F.col("place"), F.col("id"), F.col("tokens")]
    within = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("within", within).join(totals, ["source", "bucket"]).select("source", "id", "tokens", (F.col("ahead") + F.col("within")).alias("queued"), "source_tokens")


def _budgets(queued: DataFrame, targets: DataFrame, budget: int | str | None) -> DataFrame:
    """Per mix and source: weight, cap of repeats, tokens of the source, the finish time at which the mix ends, and the mix's tokens (``total``).

    Without a budget a mix ends where the first of its sources that has documents is used up
    with all its repeats: up to there every such source reaches its share. ``budget="sources"``
    is as many tokens as the mix's sources have; those too small for their share run to their cap.
    """
    rows = targets.where("target_share > 0 and max_repeats > 0 and source is not null")
    per = queued.groupBy("source").agg(F.max("source_tokens").alias("source_tokens"))
    per = rows.join(per, "source", "left").select("mix_id", "source", "target_share", "max_repeats", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"))
    mix = Window.partitionBy("mix_id")
    most = F.col("max_repeats") * F.col("source_tokens") / F.col("target_share")
    end = F.min(F.when(F.col("source_tokens") > 0, most)).over(mix)
    # What the sources have given at that time, each at most its cap.
    given = F.sum(F.least(F.col("ends") * F.col("target_share"), (F.col("max_repeats") * F.col("source_tokens")).cast("double"))).over(mix)
    given = F.round(given).cast("long").alias("total")  # whole tokens, whatever order the doubles were summed in
    if budget is None:
        return per.withColumn("ends", end).select("*", given)
    # With a budget: the finish time at which the sources, each up to its cap, have given that many tokens.
    total = F.sum("source_tokens").over(mix).cast("double") if budget == "sources" else F.lit(float(budget))
    steps = per.withColumn("most", F.when(F.col("source_tokens") > 0, most))
    order = Window.partitionBy("mix_id").orderBy(F.col("most").asc_nulls_first(), "source")
    done = F.sum(F.coalesce("most", F.lit(0.0)) * F.col("target_share")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    running = F.sum(F.when(F.col("most").isNotNull(), F.col("target_share")).otherwise(0.0)).over(order.rowsBetween(0, Window.unboundedFollowing))
    at = (total - F.coalesce(done, F.lit(0.0))) / running
    before = F.coalesce(F.lag("most").over(order), F.lit(0.0))
    reached = F.when(F.col("most").isNotNull() & (at <= F.col("most")) & (at >= before), at)
    steps = steps.withColumn("reached", reached)
    ends = F.coalesce(F.min("reached").over(mix), F.max("most").over(mix))
    return steps.withColumn("ends", ends).drop("most", "reached").select("*", given)


def mix(queued: DataFrame, targets: DataFrame, budget: int | str | None = None) -> DataFrame:
    """``(mix_id, source, doc_id, copy, tokens, finish)``: the documents of each mix, in order of their finish times until its tokens are reached.

    ``copy`` counts a document's uses from 1 to at most ``max_repeats``. ``budget`` is the total
    number of tokens of a mix, which is never exceeded; see :func:`_budgets` for the default and for ``"sources"``. Each
    source is within a document of its share, or at its cap. Sources without documents give nothing.
    Repeated target rows of a mix and source are summed, with the smallest cap.
    """
    targets = targets.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    ends = _budgets(queued, targets, budget).where("source_tokens > 0").drop("source_tokens")
    rows = queued.join(ends, "source")
    turn: Column = F.col("source_tokens").cast("double") / F.col("target_share")
    start = (F.col("queued") - F.col("tokens")) / F.col("target_share")
    # Copy c comes (c - 1) turns later. What has not begun when the mix ends need not be sorted.
    copies = F.least(F.col("max_repeats").cast("long"), F.ceil((F.col("ends") - start) / turn + 1e-9))
    rows = rows.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    finish = F.col("queued") / F.col("target_share") + (F.col("copy") - 1) * turn
    rows = rows.select("mix_id", "source", F.col("id").alias("doc_id"), F.col("copy").cast("int").alias("copy"), "tokens", finish.alias("finish"), "total")
    order = ["mix_id", "finish", "source", "doc_id", "copy"]
    rows = materialize(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    ahead = F.sum("n").over(Window.partitionBy("mix_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = rows.groupBy("mix_id", "range").agg(F.sum("tokens").alias("n")).select(F.col("mix_id").alias("m"), F.col("range").alias("r"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    within = F.sum("tokens").over(Window.partitionBy("mix_id", "range").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("within", within).join(ranges, (F.col("range") == F.col("r")) & F.col("mix_id").eqNullSafe(F.col("m")))
    return rows.where(F.col("ahead") + F.col("within") <= F.col("total")).select("mix_id", "source", "doc_id", "copy", "tokens", "finish")


def ordered_mix(mixed: DataFrame) -> DataFrame:
    """The mix in the order of finish times, by a global range sort."""
    return mixed.orderBy("mix_id", "finish", "source", "doc_id", "copy")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix_id, source, target_share, reached_share, tokens, documents, max_copy)`` for every target, sources that give nothing included."""
    got = mixed.groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), F.max("copy").alias("max_copy"))
    rows = targets.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share")).join(got, ["mix_id", "source"], "left")
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    reached = F.coalesce(F.col("tokens") / total, F.lit(0.0))
    return rows.select(
        "mix_id", "source", "target_share", F.round(reached, 6).alias("reached_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("max_copy", F.lit(0)).alias("max_copy"),
    )


def check(mixed: DataFrame, queued: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix_id, sources, over_cap, lagging)``: what a mix breaks, 0 if nothing.

    ``sources``: distinct sources of its targets. ``over_cap``: documents used more often than allowed, or twice as the same copy;
    ``lagging``: sources that could give more but lie behind the share of another by over two documents of the longest kind.
    """
    targets = targets.where("source is not null").groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    used = mixed.groupBy("mix_id", "source", "doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("top"), F.sum("tokens").alias("tokens"))
    per = used.join(targets, ["mix_id", "source"]).groupBy("mix_id", "source").agg(
        F.count_if((F.col("n") > F.col("max_repeats")) | (F.col("n") != F.col("top"))).alias("over"), F.sum("tokens").alias("tokens")
    )
    whole = queued.groupBy("source").agg(F.max("source_tokens").alias("source_tokens"), F.max("tokens").alias("longest"))
    rows = targets.join(per, ["mix_id", "source"], "left").join(whole, "source", "left").na.fill(0, ["tokens", "over", "source_tokens", "longest"])
    mix = Window.partitionBy("mix_id")
    more = F.col("tokens") < F.col("max_repeats") * F.col("source_tokens")
    lead, longest = F.max(F.col("tokens") / F.col("target_share")).over(mix), F.max("longest").over(mix)
    rows = rows.where("target_share > 0").withColumn("behind", more & (F.col("target_share") * lead - F.col("tokens") > 2 * longest))
    return rows.groupBy("mix_id").agg(F.count("*").alias("sources"), F.sum("over").cast("long").alias("over_cap"), F.count_if("behind").alias("lagging"))
