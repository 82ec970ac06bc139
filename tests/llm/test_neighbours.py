import numpy as np
import pytest

from granary.llm import neighbours as nb
from tests_data import SMALL

KIND = "chunk_id string, embedding array<float>, id string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", "y") for i, v in rows], KIND)


def brute(rows, k):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    return {a: sorted(((-round(s[i, j], 6), b) for j, b in enumerate(ids) if b != a))[:k] for i, a in enumerate(ids)}


@pytest.mark.parametrize("shard_rows", [100_000, 400])
def test_recall(spark, shard_rows):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 64))
    rows = [(f"c{i:04}", centres[i % 40] + rng.normal(size=64)) for i in range(2000)]
    got = {}
    for r in nb.nearest(frame(spark, rows), shard_rows=shard_rows).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = brute(rows, 5)
    hit = sum(len({b for _, b in want[a]} & got.get(a, set())) for a in want)
    assert all(len(v) == 5 for v in got.values()) and len(got) == 2000
    assert hit / 10_000 >= 0.9


def test_recall_on_the_vectors(spark):
    df = spark.read.parquet(f"{SMALL}/../sf0.01/chunk_vectors.parquet")
    rows = {r.chunk_id: list(r.embedding) for r in df.where("size(embedding) = 64").collect() if any(r.embedding)}
    want = brute(list(rows.items()), 5)
    got = {}
    for r in nb.nearest(df).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert sum(len({b for _, b in want[a]} & got[a]) for a in want) / sum(map(len, want.values())) >= 0.9


def test_copies_ties_and_dirt(spark, rows_of):
    e = np.eye(64)
    rows = [(f"s{i:02}", e[0]) for i in range(12)] + [("t", e[0] * 3), ("o", e[1]), ("z", np.zeros(64)), ("n", None), ("w", np.ones(32)), ("m", [None] * 64), ("q", [float("nan")] * 64), ("s00", e[0]), (None, e[2])]
    out = {}
    for r in nb.nearest(frame(spark, rows)).orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.neighbour)
    assert set(out) == {f"s{i:02}" for i in range(12)} | {"t", "o"}  # ties of s.. and t go by id
    assert out["s00"] == ["s01", "s02", "s03", "s04", "s05"] and out["s11"] == ["s00", "s01", "s02", "s03", "s04"]
    pairs = rows_of(nb.mutual_pairs(nb.nearest(frame(spark, rows)), 0.9))
    assert ("s00", "s01") in pairs and all(a < b for a, b in pairs) and not any("o" in p for p in pairs)


def test_few(spark):
    assert nb.nearest(frame(spark, [("a", np.ones(64))]).limit(0)).count() == 0
    assert nb.nearest(frame(spark, [("a", np.ones(64))])).count() == 0
    assert nb.nearest(frame(spark, [("a", np.ones(64)), ("b", np.arange(64))])).count() == 2


def test_large_numbers_and_several_vectors_of_an_id(spark):
    e = np.eye(64)
    rows = [("a", e[0] * 3e38), ("b", e[0] + e[1] * 0.1), ("c", e[5]), ("c", e[0] * 2 + e[1]), ("d", e[5] + e[6] * 0.2), ("e", e[9])]
    got = {(r.id, r.neighbour): round(r.similarity, 3) for r in nb.nearest(frame(spark, rows)).collect()}
    assert got["a", "b"] == 0.995 and got["a", "c"] == 0.894 and got["c", "d"] == 0.981 and ("c", "c") not in got
    assert nb.check(nb.nearest(frame(spark, rows)), frame(spark, rows)).first()[2:] == (0, 0)
