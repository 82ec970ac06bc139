import random

import pytest

from granary.llm import mixing as m
from pyspark.sql import functions as F

TARGETS = "mix_id string, source string, target_share double, max_repeats int"


def sizes(spark, seed=1):
    r = random.Random(seed)
    rows = [(i, "big" if i % 3 else "mid" if i % 6 else "tiny", r.randrange(1, 60)) for i in range(3000)]
    return rows, spark.createDataFrame([*rows, (9000, None, 5), (9001, "big", 0)], "id long, source string, tokens long")


@pytest.mark.parametrize("bucket_rows", [50_000, 100])
def test_shares_and_caps(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(m, "BUCKET_ROWS", bucket_rows)
    rows, df = sizes(spark)
    q = m.queue_sizes(df)
    total = {s: sum(t for _, x, t in rows if x == s) for s in ("big", "mid", "tiny")}
    ends = {r[0]: r[1] for r in q.groupBy("source").agg(F.max("queued")).collect()}
    assert ends == total and q.count() == 3000 and q.select("source", "queued").distinct().count() == 3000
    targets = spark.createDataFrame([("x", "big", 0.5, 1), ("x", "mid", 0.3, 2), ("x", "tiny", 0.2, 3), ("y", "big", 0.6, 1), ("y", "gone", 0.4, 5)], TARGETS)
    mixed = m.mix(q, targets)
    got = {(r.mix_id, r.source): r for r in m.shares(mixed, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(got[("x", s)].reached_share - share) < 0.01
    assert got[("y", "gone")].tokens == 0 and got[("y", "big")].reached_share == 1
    uses = mixed.groupBy("mix_id", "source", "doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("c"))
    assert uses.where("n <> c").count() == 0
    assert {(r[0], r[1]): r[2] for r in uses.groupBy("mix_id", "source").agg(F.max("n")).collect()}[("x", "tiny")] <= 3


def test_budget(spark):
    rows, df = sizes(spark)
    q = m.queue_sizes(df)
    targets = spark.createDataFrame([("x", "big", 0.5, 1), ("x", "tiny", 0.5, 2)], TARGETS)
    tiny = sum(t for _, x, t in rows if x == "tiny")
    small = m.mix(q, targets, budget=2000)
    assert abs(small.agg(F.sum("tokens")).first()[0] - 2000) < 120
    large = m.mix(q, targets, budget=6 * tiny)  # more than tiny can give: it gives all it may
    per = {r[0]: r[1] for r in large.groupBy("source").agg(F.sum("tokens")).collect()}
    assert per["tiny"] == 2 * tiny and abs(per["big"] - 4 * tiny) < 120
    all_ = m.mix(q, targets, budget=10**12)
    assert all_.count() == sum(1 for r in rows if r[1] == "big") + 2 * sum(1 for r in rows if r[1] == "tiny")


def test_empty_and_texts(spark):
    docs = spark.createDataFrame([(1, "some text", "a", 5), (2, None, "a", 5), (3, "more", None, 5)], "doc_id long, text string, source string, place int")
    targets = spark.createDataFrame([("x", "a", 1.0, 2), ("x", "b", 0.0, 2), (None, "a", 0.5, 1)], TARGETS)
    mixed = m.mix(m.queue(docs), targets)
    assert {(r.mix_id, r.doc_id, r.copy) for r in mixed.collect()} == {("x", 1, 1), ("x", 1, 2), (None, 1, 1)}
    none = m.mix(m.queue(docs.limit(0)), targets)
    assert none.count() == 0 and m.shares(none, targets).count() == 3
