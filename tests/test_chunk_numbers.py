"""The chunks of all documents are numbered in order."""

from granary import queries
from tests_data import SMALL


def test_chunks_are_numbered(spark):
    rows = queries.chunked_documents(spark, SMALL).select("global_index", "source_file", "doc_chunk_index", "chunk_id").orderBy("global_index").collect()
    assert [r.global_index for r in rows] == list(range(len(rows))) and rows
    assert [r[1:] for r in rows] == sorted((r[1:] for r in rows), key=lambda r: (r[0] or "", r[1], r[2]))
