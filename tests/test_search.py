import pytest

from granary.errors import AmbiguousIdError, OutOfScopeError, SearchIndexError, SearchIndexMissing, StaleSearchIndex
from granary.operators.search import SearchIndex, build, index_rows

ROWS = [
    ("a:0", "a", 0, "# Crane rules\nThe crane lifts \\$5 cargo. Red crane only.", {"module": "m1", "metadata": '{"source_document_name": "Crane Book", "resource_type": "guide"}'}),
    ("a:1", "a", 1, "Nothing about it here; the cargo-net waits.", {"module": "m1", "metadata": '{"metadata": {"type": "log"}, "task_id": ""}'}),
    ("a:2", "a", None, "A late crane note with Éclair and snake_case.", {"module": "m1"}),
    ("b:0", "b", 0, "Cargo one two three four net five six crane.", {"module": "m2", "metadata": '{"task_id": "m9"}'}),
    ("b:1", "b", 1, "", {}),
    ("c:0", "c", 0, "Cranes and eclairs. What lifts?\nWhat lifts it all?", {"metadata": "junk"}),
    ("c:10", "c", 1, None, {}),
]


@pytest.fixture(scope="module")
def index(spark, chunk_frame, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    build(chunk_frame(ROWS), path, core="k1")
    return SearchIndex.open(spark, path, "k1"), path


def ids(result):
    return sorted(r.chunk_id for r in result.hits.collect())


@pytest.mark.parametrize(
    "query, want",
    [
        ({"all": ["crane"]}, ["a:0", "a:2", "b:0"]), ({"all": ["crane", "cargo"]}, ["a:0", "b:0"]), ({"any": ["eclair", "net"]}, ["a:1", "a:2", "b:0"]), ({"all": ["crane"], "not_": ["cargo"]}, ["a:2"]),
        ({"not_": ["crane"]}, ["a:1", "b:1", "c:0", "c:10"]), ({"all": ["crane*"]}, ["a:0", "a:2", "b:0", "c:0"]), ({"phrase": ["red crane"]}, ["a:0"]), ({"all": ["cargo net"]}, ["a:1"]),
        ({"near": [("cargo", "net", 4)]}, ["a:1", "b:0"]), ({"near": [("cargo", "net", 3)]}, ["a:1"]), ({"near": [("net", "one two", 2)]}, ["b:0"]), ({"substring": ["$5 CARGO"]}, ["a:0"]),
        ({"all": ["RANE L"], "word": False}, ["a:0"]), ({"regex": [r"^what\s"]}, ["c:0"]), ({"regex": [r"(?P<x>r)ed (?P<y>c)rane"]}, ["a:0"]), ({"all": ["book"], "titles": True}, ["a:0"]), ({"all": ["book"]}, []),
        ({"all": ["snake"]}, ["a:2"]), ({"all": ["crane"], "modules": ["m9"]}, ["b:0"]), ({"all": ["crane*"], "general_only": True}, ["c:0"]), ({"all": ["crane*"], "general_only": True, "modules": ["m1"]}, ["a:0", "a:2", "c:0"]),
        ({"all": ["crane"], "docs": ["a"]}, ["a:0", "a:2"]), ({"all": ["crane"], "exclude_docs": ["a"]}, ["b:0"]), ({"types": ["guide", "log"]}, ["a:0", "a:1"]), ({"all": ["crane"], "docs": ["crane BOOK"]}, ["a:0", "a:2"]),
    ],
)
def test_truth_table(index, query, want):
    assert ids(index[0].search(**query)) == want


def test_bm25_by_hand(spark, chunk_frame):
    import math

    rows = [("1", "d", 0, "x y x"), ("2", "e", 0, "x z z z"), ("3", "f", 0, "w"), ("4", "g", 0, "w v"), ("5", "h", 0, "w")]
    got = {r.chunk_id: r.score for r in SearchIndex.over(chunk_frame(rows)).search(all=["x"]).hits.collect()}
    sizes = {"1": 4, "2": 5, "3": 2, "4": 3, "5": 2}
    mean, idf = sum(sizes.values()) / 5, math.log((5 - 2 + 0.5) / (2 + 0.5))
    for c, f in (("1", 2), ("2", 1)):
        assert got[c] == round(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sizes[c] / mean)), 4)


def test_envelope_and_scope(index):
    ix = index[0]
    found = ix.search(all=["crane*"], limit=2)
    assert (found.total, found.shown, found.truncated, found.hits.count()) == (4, 2, True, 2)
    assert {r.doc_id: r.hits for r in found.by_doc.collect()} == {"a": 2, "b": 1, "c": 1}
    assert {r.task_id: r.hits for r in found.by_module.collect()} == {"m1": 2, "m9": 1, None: 1}
    hit = {r.chunk_id: r for r in ix.search(all=["red"]).hits.collect()}["a:0"]
    assert hit.heading == "Crane rules" and "$5 cargo" in hit.snippet
    scoped = ix.where({"doc_id": "a"}).where({"doc_chunk_index": {"$exists": True}})
    assert ids(scoped.search(all=["crane"])) == ["a:0"] and ids(ix.search(all=["crane"])) == ["a:0", "a:2", "b:0"]
    assert scoped.search(all=["crane"]).hits.first().score == {r.chunk_id: r.score for r in ix.search(all=["crane"]).hits.collect()}["a:0"]
    assert tuple(scoped.scope_summary().first()) == (2, 1, 1, 0)
    assert [r.task_id for r in ix.modules().collect()] == ["m1", "m9"]


def test_reading_around(index):
    ix = index[0]
    assert [(r.offset, r.chunk_id) for r in ix.neighbors("a:1").collect()] == [(-1, "a:0"), (0, "a:1"), (1, "a:2")]
    assert [r.chunk_id for r in ix.neighbors("a:0", 0).collect()] == ["a:0"]
    out = ix.outline("a").collect()
    assert [(r.chunk_id, r.heading, r.heading_before) for r in out] == [("a:0", "Crane rules", None), ("a:1", None, "Crane rules"), ("a:2", None, "Crane rules")]
    assert ix.copies("c:0").count() == 0
    assert ix.badges(ix.chunks.select("chunk_id")).count() == 7


def test_errors(index, spark):
    ix, path = index
    with pytest.raises(AmbiguousIdError):
        ix.resolve_chunk("a:")
    assert ix.resolve_chunk("c:1") == "c:10" and ix.resolve_chunk("b:0") == "b:0"
    with pytest.raises(OutOfScopeError):
        ix.where({"doc_id": "a"}).chunk("b:0")
    for bad in ({}, {"all": ["--"]}, {"regex": ["("]}, {"all": ["x"], "limit": -1}, {"all": ["x"], "modules": ["nope"]}):
        with pytest.raises(SearchIndexError):
            ix.search(**bad)
    with pytest.raises(SearchIndexMissing):
        SearchIndex.open(spark, path + "/none")
    with pytest.raises(StaleSearchIndex):
        SearchIndex.open(spark, path, "other")


def test_promoted_fields(chunk_frame):
    rows = {r.chunk_id: r for r in index_rows(chunk_frame(ROWS)).collect()}
    assert rows["a:0"].source == "Crane Book" and rows["a:0"].resource_type == "guide" and rows["a:0"].task_id == "m1"
    assert rows["a:1"].type == "log" and rows["a:1"].task_id == "m1" and rows["b:0"].task_id == "m9" and rows["c:0"].task_id is None
    assert rows["a:0"].plain.count("\\") == 0 and rows["c:10"].plain == ""


def test_empty(chunk_frame, spark, tmp_path):
    none = chunk_frame(ROWS).limit(0)
    build(none, str(tmp_path))
    ix = SearchIndex.open(spark, str(tmp_path))
    assert ix.search(all=["x"]).total == 0 and ix.modules().count() == 0
