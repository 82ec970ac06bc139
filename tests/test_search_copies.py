"""Hits of a session index name the copy that stands for them."""

from granary.operators.search import SearchIndex


def test_hits_name_their_copy(chunk_frame):
    rows = [("a", "d1", 0, "Airlock seal"), ("b", "d2", 0, "airlock, SEAL!"), ("c", "d3", 0, "airlock winch seal")]
    hits = SearchIndex.over(chunk_frame(rows)).search(all=["airlock"], any=["seal"]).hits
    assert {r.chunk_id: r.copy_rep for r in hits.collect()} == {"a": "a", "b": "a", "c": "c"}
