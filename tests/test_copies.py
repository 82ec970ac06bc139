import random

from granary.operators import copies, ordered
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(400)]


def passage(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def test_groups(chunk_frame):
    a, footer = passage(1, 110), passage(9, 40)
    rows = [("i1", "d1", 0, "same  text"), ("i2", "d2", 0, "same text"), ("n1", "d1", 1, "Same, TEXT!"), ("e1", "d3", 0, "--"), ("e2", "d4", 0, "***"), ("x", "d5", 0, None),
            ("o1", "d6", 0, a), ("o2", "d7", 0, a + " " + passage(2, 12)), ("f1", "d8", 0, passage(3, 160) + " " + footer), ("f2", "d9", 0, passage(4, 160) + " " + footer), ("f3", "d9", 1, footer)]
    chunks = chunk_frame(rows)
    near = copies.near_table(chunks)
    reps = {r.chunk_id: r.copy_rep for r in near.collect()}
    assert reps["i1"] == reps["i2"] == reps["n1"] == "i1" and reps["e1"] == "e1" and reps["e2"] == "e2" and "x" not in reps
    pairs = {(r.chunk_a, r.chunk_b): r for r in copies.overlap_pairs(near).collect()}
    assert set(pairs) == {("o1", "o2"), ("f1", "f3"), ("f2", "f3")}  # the footer is a pair of each long chunk ...
    groups = {}
    for r in copies.copy_groups(chunks).collect():
        groups.setdefault((r.kind, r.group_id), set()).add(r.chunk_id)
    kinds = sorted((k, sorted(v)) for (k, _), v in groups.items())
    assert kinds == [("identical", ["i1", "i2"]), ("near", ["i1", "i2", "n1"]), ("overlap", ["o1", "o2"])]  # ... but chains none


def test_overlaps_exact(chunk_frame):
    r = random.Random(5)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = base[:]
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(60)] = f"z{r.randrange(9)}"
        rows.append((f"c{i:02}", "d", i, " ".join(w[: r.randrange(35, 61)])))
    near = copies.near_table(chunk_frame(rows))
    got = {(x.chunk_a, x.chunk_b) for x in copies.overlap_pairs(near).collect()}
    texts = {}
    for c, _, _, t in rows:
        texts.setdefault(t, c)
    sets = {c: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t, c in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * min(len(sets[a]), len(sets[b]))}
    assert got == want and want


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    want = {x: root(x) for x in parent}
    got = {x.node: x.root for x in copies.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == want


def test_empty(chunk_frame):
    none = chunk_frame([("a", "d", 0, "x")]).limit(0)
    assert copies.copy_groups(none).count() == 0


def test_blocks_change_nothing(spark):
    r = random.Random(2)
    rows = [(f"c{i:03}", f"d{i % 3}", r.choice([None, *range(40)]), r.choice([None, "h%d" % i])) for i in range(120)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, doc_chunk_index int, h string")
    for f in (lambda b: ordered.carry(df, F.col("h"), "o", block=b), lambda b: ordered.around(df, block=b), lambda b: ordered.following(df, ["h"], block=b)):
        assert sorted(map(str, f(10_000).collect())) == sorted(map(str, f(3).collect()))
