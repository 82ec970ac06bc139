from collections import Counter

import numpy as np
import pytest

from granary.llm import packing as p
from pyspark.sql import functions as F

CAPS = "capacity_id int, capacity_tokens int"


def test_price_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes, values, have = rng.integers(1, 12, 4), rng.random(4), rng.integers(0, 4, 4)
        best = max(
            (sum(v * n for v, n in zip(values, c)) for c in np.ndindex(*(have + 1)) if sum(s * n for s, n in zip(sizes, c)) <= 25), default=0
        )
        got = p.price(values, sizes, have, 25, np.arange(4))
        assert all(n <= have[j] for j, n in got.items()) and sum(n * sizes[j] for j, n in got.items()) <= 25
        assert sum(n * values[j] for j, n in got.items()) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_every_item_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(200, rng.lognormal(3.2, 1, 3000).astype(int) + 1)
    h = Counter(lengths.tolist())
    plan = p.plan(h, 200)
    longest, number = {}, Counter()
    for x, n in h.items():
        c = int(np.searchsorted(plan.upper, x))
        longest[c] = max(x, longest.get(c, 0))
        number[c] += n
    covered, load = Counter(), Counter()
    for cls, offset, each, first, times in plan.slots:
        assert offset == covered[cls]
        covered[cls] += each * times
        for i in range(first, first + times):
            load[i] += each * longest[cls]
    assert covered == number and max(load.values()) <= 200 and set(load) == set(range(plan.containers))
    assert plan.least == -(-int(lengths.sum()) // 200) and plan.containers <= 1.005 * plan.least + 1


def test_plan_beats_best_fit_decreasing():
    rng = np.random.default_rng(7)
    lengths = np.minimum(512, rng.lognormal(5, 0.8, 4000).astype(int) + 1)
    rooms = np.zeros(0, np.int64)
    for x in sorted(lengths.tolist(), reverse=True):
        fits = np.flatnonzero(rooms >= x)
        if len(fits):
            rooms[fits[np.argmin(rooms[fits])]] -= x
        else:
            rooms = np.append(rooms, 512 - x)
    assert p.plan(Counter(lengths.tolist()), 512).containers <= len(rooms)


def test_plan_of_few_items():
    assert p.plan({7: 1}, 7).containers == 1 and p.plan({4: 3}, 7).containers == 3
    assert p.plan({3: 2, 4: 2}, 7).containers == 2


def test_pack_table(spark, rows_of):
    sizes = [(i, n) for i, n in enumerate([0, 0, 1, 5, 10, 10, 11, 25, 30, 30, 3, 3])]
    df = spark.createDataFrame(sizes, "id long, tokens long")
    caps = spark.createDataFrame([(1, 10), (2, 100), (1, 10)], CAPS)
    out = p.pack_sizes(df, caps)
    rows = out.collect()
    for cap, most in ((1, 10), (2, 100)):
        mine = [r for r in rows if r.capacity_id == cap]
        whole = Counter()
        for r in mine:
            whole[r.id] += r.tokens
        assert whole == Counter(dict(sizes)) and {r.id for r in mine} == set(range(12))
        load = Counter()
        for r in mine:
            if r.container_id is not None:
                load[r.container_id] += r.tokens
        assert max(load.values()) <= most and set(load) == set(range(len(load)))
        assert all(len([r for r in mine if r.id == i]) == (1 if n <= most else -(-n // most)) for i, n in sizes)
    assert {r.id for r in rows if r.container_id is None} == {0, 1}


def test_pack_texts(spark):
    docs = spark.createDataFrame([(1, "hello world " * 50, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (4, "short", "x"), (None, "lost", "x")], "doc_id long, text string, tokens string")
    caps = spark.createDataFrame([(1, 64)], CAPS)
    out = p.pack(docs, caps)
    assert out.columns == ["capacity_id", "doc_id", "piece", "tokens", "container_id"]
    assert out.where("doc_id = 4").count() == 2 and out.where("doc_id = 1").agg(F.max("tokens")).first()[0] == 64
    report = p.fill_report(out, caps).first()
    assert report.containers >= report.least_containers
    assert p.pack(docs.limit(0), caps).count() == 0
    assert p.pack(docs, caps.limit(0)).count() == 0


def test_hot_length_is_spread(spark, monkeypatch):
    monkeypatch.setattr(p, "RANK_ROWS", 50)
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40 + 1).cast("long").alias("tokens"))
    out = p.pack_sizes(df, spark.createDataFrame([(1, 64)], CAPS))
    load = {r[0]: r[1] for r in out.groupBy("container_id").agg(F.sum("tokens")).collect()}
    assert out.count() == 1000 and max(load.values()) <= 64


def test_check_sees_faults(spark):
    caps = spark.createDataFrame([(1, 10)], CAPS)
    rows = [(1, 1, 0, 6, 0), (1, 2, 0, 6, 0), (1, 3, 0, 2, 2), (1, 3, 1, 2, 3)]
    out = p.check(spark.createDataFrame(rows, "capacity_id int, doc_id long, piece int, tokens int, container_id long"), caps).first()
    assert (out.documents, out.overfull, out.split_needlessly, out.unnumbered) == (3, 1, 1, 1)
