from hypothesis import given
from hypothesis import strategies as st

from granary.functions import text as t
from granary.operators.chunker import chunk_documents, number_globally, spans
from pyspark.sql import functions as F


@given(st.text("ab", max_size=14), st.text("ab", max_size=14))
def test_overlap_is_longest(a, b):
    assert t.overlap(a, b) == max(k for k in range(min(len(a), len(b)) + 1) if a.endswith(b[:k]))


def test_overlap_bound():
    assert t.overlap("x" * 9000, "x" * 9000) == 4000


def test_near_words():
    assert t.near_words("Donâ€™t, CAFÃ©!") == t.near_words("don’t café") == ["don", "t", "cafe"]
    assert t.near_words("Straße_x 5\\*") == ["strasse_x", "5"]
    assert t.near_words("") == []


def test_search_tokens():
    assert t.search_tokens("snake_case Éa-2") == ["snake", "case", "ea", "2"]


def test_headings():
    text = "# One #\nbody\n\n**Two:**\n\nWhat is three?\nbody ends here\nWhat is not?\n[00:10] spk_1: why so?"
    assert t.headings(text) == [(0, "One"), (14, "Two"), (24, "What is three?")]


def test_columns(spark):
    df = spark.createDataFrame([("a\\$b \\\n c", "uuid"), (None, None), ("x" * 400, "123"), ("", "ü")], "x string, s string")
    out = df.select(t.plain("x").alias("p"), t.collapsed(t.plain("x")).alias("c"), t.human_source(F.col("s")).alias("h"), t.snippet(F.col("x"), F.lit(150)).alias("n"), t.folded("x")).collect()
    assert out[0].p == "a$b \n c" and out[0].c == "a$b c" and out[0].h
    assert out[1].p is None and out[1].h is False
    assert out[2].n.startswith("…") and out[2].n.endswith("…") and len(out[2].n) == 302 and out[2].h is False


@given(st.text(" ab.\n?", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_spans(text, size, overlap):
    found = list(spans(text, size, overlap))
    for s, e in found:
        assert text[s:e] == text[s:e].strip() != "" and e - s <= size
    assert all(not (a[0] <= b[0] and b[1] <= a[1]) for a, b in zip(found, found[1:]))
    covered = set().union(*[range(s, e) for s, e in found]) if found else set()
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_hand_split():
    text = "First part.\n\nAnd second bit with tail end."
    assert [text[s:e] for s, e in spans(text, 30, 5)][0] == "First part.\n\nAnd second bit"


def test_chunk_table(spark):
    docs = spark.createDataFrame(
        [("b.txt", "f", "B.txt", "b.txt", "txt", "one two three " * 20), ("a.md", "", "A.md", "a.md", "md", "short"), ("c", "", "c", "c", "md", None), ("d", "", "d", "d", "md", " \n ")],
        "source_identity string, source_fingerprint string, relative_path string, filename string, file_type string, content string",
    )
    chunks = number_globally(chunk_documents(docs, 100, 20))
    rows = sorted(chunks.collect(), key=lambda r: r.global_index)
    assert [r.global_index for r in rows] == list(range(len(rows)))
    assert rows[0].doc_id == "a.md" and {r.doc_id for r in rows} == {"a.md", "b.txt"}
    content = "one two three " * 20
    assert all(content[r.char_start : r.char_end] == r.text for r in rows if r.doc_id == "b.txt")
