import random

import pytest

from granary.errors import PromptTemplateError, RetrievalModeError
from granary.functions import prompts as pr
from granary.operators import book, retrieval, signals
from granary.streaming import ingest
from pyspark.sql import functions as F

HIT = "query_id string, rank int, chunk_id string, score double, role string, origin string, text string"


def hits(spark, rows):
    return spark.createDataFrame([("q", *r, "text " + str(r[1])) for r in rows], HIT)


@pytest.mark.parametrize(
    "mode, rows, status, ranked",
    [
        ("scored", [(1, "a", 0.2, "match", None), (2, "b", 0.9, None, None), (3, "a", 0.5, None, None)], "scores", ["b", "a"]),
        ("scored", [(1, "a", None, "match", None), (2, "b", 0.9, None, None)], "error", []),
        ("scored", [(1, "a", None, "context", "neighbour")], "not_applicable", []),
        ("ordered", [(2, "b", None, None, None), (1, "a", None, None, None), (3, "c", None, "context", None)], "returned_order", ["a", "b"]),
        ("complete_set", [(1, "a", None, None, None), (2, "b", 0.1, None, None)], "scores", ["b"]),
        ("complete_set", [(1, "a", None, None, None)], "not_applicable", []),
        ("scored", [(1, "a", 0.5, None, None), (2, "b", 0.5, None, None)], "scores", ["a", "b"]),
    ],
)
def test_ranking(spark, mode, rows, status, ranked):
    r = retrieval.ranking_basis(hits(spark, rows), mode).first()
    assert (r.status, r.ranked_ids) == (status, ranked)
    assert r.returned_ids == list(dict.fromkeys(x[1] for x in sorted(rows)))


def test_modes_and_thresholds(spark):
    assert retrieval.resolve_mode("scored", "ordered") == "ordered"
    for bad in (("ordered", "scored"), ("complete_set", "ordered"), ("odd", None)):
        with pytest.raises(RetrievalModeError):
            retrieval.resolve_mode(*bad)
    df = hits(spark, [(1, "a", 0.2, None, None), (2, "b", 0.9, None, None)])
    assert retrieval.apply_threshold(df, "scored", 0.5).count() == 1 and retrieval.apply_threshold(df, "ordered", None).count() == 2
    with pytest.raises(RetrievalModeError):
        retrieval.apply_threshold(df, "ordered", 0.5)
    assert retrieval.depth(None) == 5 and retrieval.depth(None, 7) == 7 and retrieval.depth(2, 7) == 2
    with pytest.raises(RetrievalModeError):
        retrieval.depth(0)


ITEM = "query_id string, rank int, chunk_id string, score double, item_index int, item_kind string, item_covered_ids array<string>, item_role string, item_origin string"


def test_items(spark):
    rows = [("q", 1, "a", 0.5, 0, "passage", None, "match", None), ("q", 2, "s", 0.4, 1, "group", ["x", "y"], None, None), ("q", 3, "b", None, 0, "passage", None, "context", "neighbour"), ("q", 4, None, None, None, "gap", None, None, None),
            ("q", 5, "c", 0.1, None, None, None, None, None)]
    out = [(r.kind, r.covered_ids, r.row_ranks, r.score, r.has_match) for r in retrieval.items(spark.createDataFrame(rows, ITEM)).orderBy("item_rank").collect()]
    assert out == [("passage", ["a", "b"], [1, 3], 0.5, True), ("summary", ["x", "y"], [2], 0.4, True), ("gap", [], [4], None, False), ("chunk", ["c"], [5], 0.1, True)]
    assert retrieval.item_problems(spark.createDataFrame(rows, ITEM)).count() == 0
    bad = [("q", 1, None, 0.5, -1, "passage", ["x"], "context", None), ("q", 2, "a", None, None, "odd", ["a", "a", ""], "boss", " "), ("q", 3, "a", 0.1, 0, "gap", ["a"], "match", None)]
    assert [len(r.problems) for r in retrieval.item_problems(spark.createDataFrame(bad, ITEM)).orderBy("rank").collect()] == [4, 5, 2]


def test_topk_against_brute_force(spark):
    import numpy as np

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(900, [0.0] * 8), (901, None), (902, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 50 = 0 and vec_id < 900").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    x = np.array([r[1] for r in rows[:200]])
    s = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in retrieval.vector_topk(v, q, 5, query_bytes=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {i: np.argsort(-(s @ s[i]), kind="stable")[:5].tolist() for i in range(0, 200, 50)}
    assert retrieval.vector_topk(v, q.limit(0), 5).count() == 0 and retrieval.vector_topk(v.limit(0), q, 5).count() == 0
    a = v.where("vec_id < 3").select(retrieval.cosine(F.col("embedding"), F.col("embedding")).alias("c")).collect()
    assert all(abs(r.c - 1) < 1e-12 for r in a)


# Prompts -------------------------------------------------------------------------------

GOOD = pr.PromptTemplate("t.1", "d", "Use:\n{rag_block}\nAnswer {query}", "Be brief", "after_rag_block")


@pytest.mark.parametrize(
    "change",
    [
        {"template": "{query}"}, {"template": "{rag_block} {rag_block} {query}"}, {"template": "{rag_block}"}, {"template": "{rag_block} {query} {other}"}, {"template": "{rag_block} {query} {chat_history}"}, {"id": "-x"}, {"id": "x" * 65}, {"description": " "},
        {"template": "{rag_block} {query}\nAssistant: yes"}, {"template": "{rag_block} {query} <|im_start|>"}, {"system": "As in the conversation so far"}, {"template": "{query} {rag_block}"}, {"cache_breakpoint": "odd"}, {"cache_breakpoint": "system_end", "system": None},
        {"template": "{rag_block} {query} see previous messages"}, {"system": "{query}"},
    ],
)
def test_bad_templates(change):
    from dataclasses import replace

    with pytest.raises(PromptTemplateError):
        pr.validate([replace(GOOD, **change)])


def test_rendering(spark):
    assert pr.validate([GOOD]) == [GOOD]
    with pytest.raises(PromptTemplateError):
        pr.validate([GOOD, GOOD])
    r = pr.render(GOOD, "what {rag_block}?", "[1] {query}")
    assert r.messages == (("system", "Be brief"), ("user", "Use:\n[1] {query}\nAnswer what {rag_block}?")) and r.cacheable_prefix == "Use:\n[1] {query}"
    table = pr.render_table(GOOD, spark.createDataFrame([("q", "what {rag_block}?", "[1] {query}")], "query_id string, query string, block string")).first()
    assert table.prompt == r.messages[1][1] and table.breakpoint == r.breakpoint and table.block_sha256 == r.block_sha256
    block = retrieval.rag_blocks(hits(spark, [(2, "b", 0.1, None, None), (1, "a", 0.2, None, None)])).first().block
    assert block == "[1] chunk_id=a\ntext a\n\n[2] chunk_id=b\ntext b"


def test_generation(spark):
    def llm(system, prompt):
        if "boom" in prompt:
            raise RuntimeError("no")
        return 'Sure: {"answer": "yes", "cited": [2, "1", "odd", 9]}'

    rows = spark.createDataFrame([("q", None, "p", ["a", "b"]), ("r", "s", "boom", ["a"])], "query_id string, system string, prompt string, chunk_ids array<string>")
    out = {r.query_id: r for r in pr.generate(rows, llm).collect()}
    assert out["q"].answer == "yes" and out["q"].cited == ["b", "a", "odd", "9"] and out["r"].error == "RuntimeError: no"
    assert pr.token_usage({"prompt_tokens": 3, "completion_tokens": 4}) == {"input": 3, "output": 4, "total": 7} and pr.token_usage(None)["total"] is None


# Book and signals -----------------------------------------------------------------------


def test_mentions():
    leads = {"route": (True, 3), "arrive": (False, 1), "post": (True, 2)}
    found = book.mentions("Arrive 30 minutes early on Route 66. The Harbor of Dunes Committee met Since 1947 at Post 1966, see Marla.", book.STOPWORDS, leads)
    assert found == ["Route 66", "Post 1966", "Harbor of Dunes Committee", "Marla"]
    assert book.headings("# One\n## 1999\n### A. B\n#### deep\n# One\n## Two words ##") == ["One", "Two words"]


def test_book(chunk_frame):
    text = "# Harbor Rules\nThe crew at Pier 4 met Olga Brandt today, near Pier 9."
    rows = [("a:0", "guide.md", 0, text), ("a:1", "guide.md", 1, "more about Olga Brandt and Pier 4"), ("b:0", "0a1b2c3d-0000-0000-0000-000000000000::0a1b2c3d-0000-0000-0000-000000000001", 0, text), ("c:0", "z.md", 0, "# Other\nThen Olga Brandt left")]
    ix = book.BookIndex(chunk_frame(rows))
    terms = {r.term: r.kind for r in ix.entries.collect()}
    assert terms["Harbor Rules"] == "topic" and terms["Olga Brandt"] == "entity" and terms["guide.md"] == "topic" and terms["Pier 4"] == "entity"
    found = {r.chunk_id: r for r in ix.lookup("olga").collect()}
    assert set(found) == {"a:0", "a:1", "c:0"} and found["a:0"].copies == ["b:0"] and found["a:0"].section == "Harbor Rules" and found["a:0"].next == "a:1" and found["a:1"].section == "Harbor Rules"
    scope = chunk_frame(rows).where("chunk_id in ('b:0', 'c:0')").select("chunk_id")
    scoped = {r.chunk_id: r for r in ix.lookup("OLGA", scope).collect()}
    assert set(scoped) == {"b:0", "c:0"} and scoped["b:0"].copies == [] and scoped["b:0"].prev == ""
    parts = {(r.title, r.part, r.chunk_id) for r in ix.threads.collect()}
    assert ("Harbor Rules", 0, "a:0") in parts and ("Harbor Rules", 0, "a:1") in parts and any(t == "Harbor Rules" and c == "b:0" for t, _, c in parts)
    assert any("Olga Brandt" in line for line in ix.render())
    assert book.BookIndex(chunk_frame(rows).limit(0)).entries.count() == 0


def test_signals(spark, chunk_frame, tmp_path):
    rows = [("a:0", "a", 0, "one"), ("a:1", "a", 1, "two"), ("b:0", "b", 0, "One"), ("b:1", "b", 1, "two"), ("c:0", "c", 0, "bad")]

    def label(system, prompt):
        if "bad" in prompt:
            raise ValueError("refused")
        return '{"subjects": [{"first": 1, "words": ["Crane"]}, {"first": "2", "last": 2, "words": "crane"}, {"first": 7, "words": ["no"]}]}', 10, 2

    out = {r.primary: r for r in signals.build(chunk_frame(rows), str(tmp_path / "s"), label).collect()}
    assert set(out) == {"a", "c"} and out["a"].doc_ids == ["a", "b"] and out["c"].error and out["a"].input_tokens == 10
    assert [(s.words, s.chunk_ids) for s in out["a"].subjects] == [(["Crane"], ["a:0", "a:1"])]
    again = signals.build(chunk_frame(rows), str(tmp_path / "s"), lambda s, p: ("{}", 1, 1))
    assert {r.primary: r.error for r in again.collect()} == {"a": None, "c": None}
    assert signals.find(again, "RAN").count() == 1
    assert signals.slices(["aa", "bb", "c" * 9, "d"], 4) == [(0, 2), (2, 3), (3, 4)] and signals.slices([]) == []


# Streams --------------------------------------------------------------------------------


def test_ingest(spark, tmp_path):
    def arrive(name, content, version):
        row = [(f"{name}.txt", name, f"{name}.txt", "txt", content, name, version)]
        spark.createDataFrame(row, ingest.DOCUMENT).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), 50, 10).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    arrive("a", "words " * 40, "1")
    first = run().count()
    assert first > 3
    arrive("b", "short", "1")
    arrive("a", "words " * 40, "1")  # comes again: nothing new
    assert run().count() == first + 1
    assert run().count() == first + 1


def test_windows(spark, tmp_path):
    from tests_data import SMALL

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    for make, name in ((lambda d: ingest.windowed_counts(d, "ts", "event_type"), "w"), (lambda d: ingest.sessions(d, "ts", "user_id"), "s")):
        q = make(stream).writeStream.outputMode("complete" if name == "w" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.table(name).agg(F.sum("n")).first()[0]
        want = make(events).agg(F.sum("n")).first()[0]
        assert want == events.count() and (got == want if name == "w" else got <= want)


def test_cli(spark, tmp_path, capsys):
    from granary import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("The crane lifts cargo. " * 80)
    assert cli.main(["list"]) == 0
    assert cli.main(["dataset", "build", "--folder", str(tmp_path / "in"), "--out", str(tmp_path / "ds")]) == 0
    assert cli.main(["index", "status", "--dataset", str(tmp_path / "ds")]) == 0
    assert cli.main(["index", "prepare", "--dataset", str(tmp_path / "ds")]) == 0
    capsys.readouterr()
    assert cli.main(["index", "search", "--dataset", str(tmp_path / "ds"), "--term", "crane", "--json"]) == 0
    assert '"score"' in capsys.readouterr().out
    assert cli.main(["index", "sql", "SELECT count(*) AS n FROM chunks", "--dataset", str(tmp_path / "ds")]) == 0
    assert cli.main(["index", "sql", "DROP TABLE chunks", "--dataset", str(tmp_path / "ds")]) == 1
    assert cli.main(["dataset", "verify", "--dataset", str(tmp_path / "ds")]) == 0
    assert cli.main(["dataset", "verify", "--dataset", str(tmp_path / "none")]) == 1
    assert cli.main(["dataset", "list", "--dir", str(tmp_path)]) == 0
