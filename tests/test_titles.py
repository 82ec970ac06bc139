"""A title stands for all of its documents, however many."""

from granary.operators.search import SearchIndex


def test_more_documents_of_a_title_than_an_error_shows(chunk_frame):
    rows = [(f"c{i}", f"d{i}", 0, "airlock seal", {"source_file": "Manual"}) for i in range(9)] + [("x", "dx", 0, "airlock", {"source_file": "Other"})]
    index = SearchIndex.over(chunk_frame(rows))
    got = index.search(all=["airlock"], docs=["manual"])
    assert got.total == 9 and got.by_doc.count() == 9 and index.search(docs=["MANUAL", "d0"]).total == 9
    rest = index.search(all=["airlock"], exclude_docs=["Manual"])
    assert [r.chunk_id for r in rest.hits.collect()] == ["x"] and rest.total == 1
    assert index.outline("Manual").count() == 9 and index.resolve_doc("manual") == [f"d{i}" for i in range(9)]
