"""Filling containers of fixed capacity: a configuration linear program over the length histogram.

Only histograms of lengths are solved for: at most as many numbers as the capacity, however
many items there are, one task per capacity. Lengths are grouped into narrow classes. The covering
program (fewest containers such that every class is covered) is solved by multiplicative weights:
a class's price is its length times a weight that falls exponentially with the share of it that
is covered, so all classes are used up at the same pace; a knapsack dynamic program finds the
configuration of the greatest price, and a number of containers follow it that covers a bounded
share of what is left of any class. Every step is rounded to whole containers as it is made and
covers no class beyond its demand, so nothing is left over for another method. Smaller steps are
taken while the number of containers is further from the program's lower bound than a gap.
The plan says how many containers follow each configuration; items learn their container from
their rank within their class, by a join with the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.tokens import VOCABULARY, token_sizes
from granary.session import materialize

#: Items ranked together in one task.
RANK_ROWS = 100_000
#: Ranks of a class that share a row of the plan.
PLAN_RANKS = 1024
#: Width of a length class; how far the plan may be from the lower bound before smaller steps are tried; the steps.
CLASS_RATIO, GAP, STEPS = 1.005, 0.0015, (0.5, 0.25)


@dataclass
class Plan:
    """``upper``: class bounds; runs of ``times`` containers from ``first`` on with ``each`` items of a class from rank ``offset``; ``least``: the lower bound."""

    upper: np.ndarray
    slots: list[tuple[int, int, int, int, int]]  # class, offset, each, first, times
    containers: int
    least: int


def length_classes(capacity: int, ratio: float = CLASS_RATIO) -> np.ndarray:
    """Ascending upper bounds of the length classes, the capacity last; small lengths are exact."""
    bounds, size = [], 1
    while size < capacity:
        bounds.append(size)
        size = max(size + 1, int(size * ratio))
    return np.array([*bounds, capacity])


def contenders(values: np.ndarray, sizes: np.ndarray, available: np.ndarray, capacity: int, classes: np.ndarray, known: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The classes that can be in a configuration worth more than one that is easy to find or of value ``known``, and how many of each.

    Items in the order of value per length, the last cut to fit, bound what any configuration is worth. An item of a class below
    that cut lowers the bound by what it is worth less than the cut at its length. Where the bound falls below what is reached by copies of one class and
    one item beside them, by the items that fit in that order, or by ``known``, no such configuration is the best.
    """
    most = np.minimum(capacity // sizes[classes], available[classes])
    classes, most = classes[most > 0], most[most > 0]
    v, s = values[classes], sizes[classes]
    worth = v / s
    order = np.argsort(-worth, kind="stable")
    filled = np.cumsum((most * s)[order])
    if not len(filled) or filled[-1] <= capacity:
        return classes, most
    k = int(np.searchsorted(filled, capacity))
    last, room = order[k], capacity - (int(filled[k - 1]) if k else 0)
    lower = max(known, float((most * v)[order[:k]].sum() + room // s[last] * v[last]))
    # The most valuable single item by the room for it.
    by_size = np.argsort(s, kind="stable")
    top = np.maximum.accumulate(v[by_size])
    which = by_size[np.maximum.accumulate(np.where(v[by_size] == top, np.arange(len(top)), 0))]
    for copies in (np.minimum(most, 1), np.minimum(most, 2), most):
        at = np.searchsorted(s[by_size], capacity - copies * s, "right") - 1
        beside = (at >= 0) & ~((which[at] == np.arange(len(s))) & (copies == most))
        lower = max(lower, float((copies * v + np.where(beside, top[at], 0)).max()))
    gain = v - worth[last] * s
    upper = worth[last] * capacity + float((most * np.maximum(gain, 0)).sum())
    with np.errstate(divide="ignore"):
        most = np.where(gain < 0, np.minimum(most, (upper - lower + 1e-6 * upper) / -gain), most).astype(np.int64)
    return classes[most > 0], most[most > 0]


def price(values: np.ndarray, sizes: np.ndarray, available: np.ndarray, capacity: int, classes: np.ndarray, known: float = 0.0) -> dict[int, int]:
    """The configuration of greatest value made of ``classes``: a knapsack dynamic program over its :func:`contenders`, copies by powers of two. ``known``: the value of one that is known.

    At most two items over a third of the capacity fit. Each one and two of them are tried with the best of the shorter ones in the rest of the room.
    """
    classes, most_ = contenders(values, sizes, available, capacity, classes, known)
    large = 3 * sizes[classes] > capacity
    best, room_ = np.zeros(capacity + 1, np.float32), np.empty(capacity + 1, np.float32)
    steps: list[tuple[int, int, int, np.ndarray]] = []
    for j, most in zip(classes[~large].tolist(), most_[~large].tolist()):
        size, copies = int(sizes[j]), 1
        while most > 0:
            take = min(copies, most)
            weight = size * take
            with_it = np.add(best[: capacity + 1 - weight], np.float32(values[j] * take), out=room_[weight:])
            steps.append((j, take, weight, with_it > best[weight:]))
            np.maximum(best[weight:], with_it, out=best[weight:])
            most -= take
            copies *= 2
    counts: dict[int, int] = {}
    room, reached = capacity, float(best[-1])
    if large.any():
        long, s, v = classes[large], sizes[classes[large]], values[classes[large]]
        one = v + best[capacity - s]
        if one.max() > reached:
            reached, counts = float(one.max()), {int(long[one.argmax()]): 1}
        half = np.flatnonzero(2 * s <= capacity)
        if len(half):
            rest = capacity - s[half][:, None] - s
            fits = rest >= 0
            fits[np.arange(len(half)), half] &= most_[large][half] > 1
            two = np.where(fits, v[half][:, None] + v + best[np.maximum(rest, 0)], -1)
            i, j = divmod(int(two.argmax()), len(s))
            if two[i, j] > reached:
                counts = {int(long[half[i]]): 1}
                counts[int(long[j])] = counts.get(int(long[j]), 0) + 1
        room -= sum(int(sizes[j]) * n for j, n in counts.items())
    for j, take, weight, better in reversed(steps):
        if room >= weight and better[room - weight]:
            counts[j] = counts.get(j, 0) + take
            room -= weight
    return counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, step: float, rate: float = 0.25, tilt: float = 0.05, partial: int = 32, probe: int = 32) -> list[tuple[dict[int, int], int]]:
    """Configurations and how many containers follow each; together they cover the demand exactly.

    Prices start a little more than proportional to length (``tilt``), since fewer configurations take the long classes.
    A configuration is priced over the ``partial`` least covered classes and the shortest ones; where it leaves more than a
    thousandth of the container empty, over four times as many, and so on to all. Where all leave more empty, as
    much is accepted for the next ``probe`` configurations.
    """
    left, volume = demand.copy(), float((sizes * demand).sum())
    start = sizes * (sizes / capacity) ** tilt
    runs: list[tuple[dict[int, int], int]] = []
    aim, since = 0.999 * capacity, 0
    while left.any():
        open_ = np.flatnonzero(left)
        covered = 1 - left / demand
        mean = 1 - float((sizes * left).sum()) / volume
        values = start * np.exp(rate * (mean - covered))
        order = open_[np.lexsort((-sizes[open_], covered[open_]))]
        since += 1
        aim = 0.999 * capacity if since > probe else aim
        width, known = partial, 0.0
        while True:
            config = price(values, sizes, left, capacity, np.union1d(order[:width], open_[: partial // 4]) if width < len(order) else open_, known)
            known = sum(values[j] * n for j, n in config.items())
            fill = sum(int(sizes[j]) * n for j, n in config.items())
            if fill >= aim:
                break
            if width >= len(order):
                aim, since = fill - 0.001 * capacity, 0
                break
            width *= 4
        times = max(1, int(step * min(int(left[j]) // n for j, n in config.items())))
        for j, n in config.items():
            left[j] -= n * times
        runs.append((config, times))
    return runs


def plan(histogram: dict[int, int], capacity: int, steps: tuple[float, ...] = STEPS, gap: float = GAP) -> Plan:
    """Containers for ``histogram`` (length, at most the capacity, to number of items)."""
    upper = length_classes(capacity)
    lengths = np.array(sorted(histogram), np.int64)
    number = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    # Prices proportional to lengths are feasible for the dual: no solution has fewer containers than the volume asks for.
    least = -(-int((lengths * number).sum()) // capacity)
    classes = np.searchsorted(upper, lengths)
    total = np.bincount(classes, weights=number, minlength=len(upper)).astype(np.int64)
    present = np.flatnonzero(total)
    longest = np.zeros(len(upper), np.int64)  # a class's size is its longest item that is there
    np.maximum.at(longest, classes, lengths)
    best: list[tuple[dict[int, int], int]] = []
    for step in steps:
        runs = solve(longest[present], total[present], capacity, step)
        if not best or sum(n for _, n in runs) < sum(n for _, n in best):
            best = runs
        if sum(n for _, n in best) <= math.ceil(least * (1 + gap)):
            break
    slots, offset, first = [], np.zeros(len(present), np.int64), 0
    for config, times in best:
        for j, each in sorted(config.items()):
            slots.append((int(present[j]), int(offset[j]), each, first, times))
            offset[j] += each * times
        first += times
    return Plan(upper, slots, first, least)


def _planned(capacities: dict, schema: str):
    """Solves one capacity's histogram: rows ``slot`` of the plan and, per length, its class and the rank its items start from."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf["capacity_id"].iloc[0]
        histogram = dict(zip(pdf["tokens"].tolist(), pdf["n"].tolist()))
        made = plan(histogram, capacities[c])
        rows = [(c, *s, None) for s in made.slots]
        last, start = -1, 0
        for length in sorted(histogram):
            cls = int(np.searchsorted(made.upper, length))
            start = start if cls == last else 0
            rows.append((c, cls, start, None, None, None, length))
            start, last = start + histogram[length], cls
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
        return out.astype({k: "Int64" for k in ("offset", "each", "first", "times", "tokens")})

    return run


def pack(docs: DataFrame, capacities: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, max_capacities: int = 1000) -> DataFrame:
    """``(capacity_id, doc_id, piece, tokens, container_id)`` for every document and capacity.

    A document within the capacity is one piece, numbered 0. A longer one is split into
    full containers and a rest, pieces numbered in order. Texts without a token need no room:
    their ``container_id`` is null. Container ids run from 0 for each capacity, without gaps.
    Null ids are packed like others; repeated rows are repeated items. Capacities must be positive
    and at most ``max_capacities``.
    """
    sizes = materialize(token_sizes(docs, [id_col], text_col, vocabulary).select(F.col(id_col).alias("id"), "tokens"), "token-sizes")
    return pack_sizes(sizes, capacities, max_capacities).withColumnRenamed("id", id_col)


def pack_sizes(sizes: DataFrame, capacities: DataFrame, max_capacities: int = 1000) -> DataFrame:
    """:func:`pack` for items ``(id, tokens)`` whose sizes are known."""
    listed = capacities.where("capacity_tokens > 0").select("capacity_id", "capacity_tokens").distinct().limit(max_capacities + 1).collect()
    if len(listed) > max_capacities:
        raise ValueError(f"more than {max_capacities} capacities")
    kind = dict(capacities.dtypes)["capacity_id"]
    if not listed:
        return sizes.sparkSession.createDataFrame([], f"capacity_id {kind}, id {dict(sizes.dtypes)['id']}, piece int, tokens int, container_id long")
    caps = F.array(*[F.struct(F.lit(r[0]).cast(kind).alias("capacity_id"), F.lit(r[1]).cast("long").alias("cap")) for r in listed])
    items = sizes.select("id", F.col("tokens").alias("size"), F.explode(caps).alias("c")).select("id", "size", "c.capacity_id", "c.cap")
    whole = F.floor(F.col("size") / F.col("cap"))
    items = items.withColumn("full", F.when(F.col("size") > F.col("cap"), whole).otherwise(F.lit(0)).cast("long"))
    items = items.withColumn("rest", F.col("size") - F.col("full") * F.col("cap"))
    # Spread by a hash: no task ranks more than about RANK_ROWS items, whatever length is common.
    rows, tokens = sizes.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    salts = max(1, math.ceil((rows + tokens / min(r[1] for r in listed)) / RANK_ROWS))
    pieces = items.select(
        "capacity_id", "cap", "id", "size",
        F.explode(F.when(F.col("full") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("full") - F.when(F.col("rest") == 0, 1).otherwise(0)))).alias("piece"),
        "full", "rest",
    )
    pieces = pieces.select(
        "capacity_id", "id", F.col("piece").cast("int").alias("piece"),
        F.when(F.col("piece") < F.col("full"), F.col("cap")).otherwise(F.col("rest")).cast("int").alias("tokens"),
        F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int").alias("salt"),
    )
    counts = pieces.where("tokens > 0").groupBy("capacity_id", "tokens", "salt").agg(F.count("*").alias("n"))
    counts = materialize(counts, "lengths-by-salt")
    # One task per capacity, whatever the adaptive planner thinks of so few rows; a group has at most as many rows as its capacity.
    histograms = counts.groupBy("capacity_id", "tokens").agg(F.sum("n").alias("n")).repartitionByRange(len(listed), "capacity_id")
    schema = f"capacity_id {kind}, class int, offset long, each long, first long, times long, tokens long"
    made = materialize(histograms.groupBy("capacity_id").applyInPandas(_planned({r[0]: int(r[1]) for r in listed}, schema), schema), "packing-plan")

    before = F.sum("n").over(Window.partitionBy("capacity_id", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = made.where("tokens is not null").select("capacity_id", F.col("tokens").cast("int").alias("tokens"), "class", F.col("offset").alias("start"))
    offsets = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n").join(starts, ["capacity_id", "tokens"])
    rank = F.row_number().over(Window.partitionBy("capacity_id", "tokens", "salt").orderBy("id", "piece")) - 1
    ranked = pieces.where("tokens > 0").withColumn("rank", rank).join(offsets, ["capacity_id", "tokens", "salt"])
    ranked = ranked.select("capacity_id", "id", "piece", "tokens", "class", (F.col("rank") + F.col("before") + F.col("start")).alias("rank"))
    ranked = ranked.withColumn("part", F.floor(F.col("rank") / PLAN_RANKS))
    runs = made.where("tokens is null").withColumn("part", F.explode(F.sequence(F.floor(F.col("offset") / PLAN_RANKS), F.floor((F.col("offset") + F.col("each") * F.col("times") - 1) / PLAN_RANKS))))
    runs = runs.groupBy("capacity_id", "class", "part").agg(F.array_sort(F.collect_list(F.struct("offset", "each", "first"))).alias("runs"))  # at most PLAN_RANKS + 1
    run = F.element_at(F.filter("runs", lambda r: r["offset"] <= F.col("rank")), -1)
    packed = ranked.join(runs, ["capacity_id", "class", "part"]).withColumn("run", run)
    packed = packed.select("capacity_id", "id", "piece", "tokens", (F.col("run.first") + F.floor((F.col("rank") - F.col("run.offset")) / F.col("run.each"))).alias("container_id"))
    empty = pieces.where("tokens = 0").select("capacity_id", "id", "piece", "tokens", F.lit(None).cast("long").alias("container_id"))
    return packed.unionByName(empty)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """``(capacity_id, containers, tokens, least_containers, unused_share)`` of a packing."""
    per = packed.where("container_id is not null").groupBy("capacity_id").agg((F.max("container_id") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    per = per.join(capacities.select("capacity_id", "capacity_tokens").distinct(), "capacity_id")
    cap = F.col("capacity_tokens")
    return per.select(
        "capacity_id", "containers", "tokens", F.ceil(F.col("tokens") / cap).alias("least_containers"),
        F.round(1 - F.col("tokens") / (F.col("containers") * cap), 6).alias("unused_share"),
    )


def check(packed: DataFrame, capacities: DataFrame, id_col: str = "doc_id", gap: float = 0.005) -> DataFrame:
    """``(capacity_id, documents, overfull, split_needlessly, unnumbered, over_gap)``: what a packing breaks, 0 if nothing.

    ``documents``: distinct ids packed. ``overfull``: containers over the capacity; ``split_needlessly``: documents in pieces that fit
    whole; ``unnumbered``: numbers below the greatest container id without a container; ``over_gap``: 1 if there are
    more containers than the least possible by over ``gap``, and one.
    """
    caps = capacities.where("capacity_tokens > 0").select("capacity_id", "capacity_tokens").distinct()
    load = packed.where("container_id is not null").groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("load")).join(caps, "capacity_id")
    per = load.groupBy("capacity_id").agg(
        F.count_if(F.col("load") > F.col("capacity_tokens")).alias("overfull"), (F.max("container_id") + 1 - F.count("*")).alias("unnumbered"), F.count("*").alias("n"), F.sum("load").alias("tokens"), F.first("capacity_tokens").alias("cap"),
    )
    whole = packed.groupBy("capacity_id", id_col).agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.count_distinct("piece").alias("numbers"))
    whole = whole.join(caps, "capacity_id").groupBy("capacity_id").agg(
        F.count("*").alias("documents"), F.count_if((F.col("numbers") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("split_needlessly")
    )
    over = (F.col("n") > F.ceil(F.ceil(F.col("tokens") / F.col("cap")) * (1 + gap)) + 1).cast("long")
    return whole.join(per, "capacity_id").select("capacity_id", "documents", "overfull", "split_needlessly", "unnumbered", over.alias("over_gap"))
