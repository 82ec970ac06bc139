import re

from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import splitting as s

text = st.lists(st.sampled_from(["word", "a", " ", "  ", "\n", "\n\n", "\r\n", ". ", "! ", "x" * 30, "😀", "\t"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(text, st.integers(1, 40), st.integers(0, 20))
def test_pieces(t, limit, overlap):
    pieces = s.split(t, limit, overlap)
    if not t:
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(0 < b - a <= limit for a, b, _ in pieces)
    assert "".join(t[max(a, e) : b] for (a, b, _), e in zip(pieces, [0, *[p[1] for p in pieces]])) == t
    for a, b, kind in pieces[:-1]:
        if kind:
            assert t[b - 1].isspace()


@given(st.lists(st.integers(1, 4), min_size=1, max_size=50), st.data())
def test_range_maximum(strength, data):
    import numpy as np

    lo = data.draw(st.integers(0, len(strength) - 1))
    hi = data.draw(st.integers(lo + 1, len(strength)))
    best = s.RangeMax(np.array(strength)).best(lo, hi)
    assert best == max(range(lo, hi), key=lambda i: (strength[i], i))


def test_cuts_at_the_strongest():
    t = "First sentence here. Second one goes on.\n\nNext paragraph starts here and runs on for a while longer."
    pieces = s.split(t, 60, 10)
    assert t[: pieces[0][1]].endswith("\n\n") and pieces[0][2] == s.PARAGRAPH
    assert t[pieces[1][0] :].startswith("goes on.") or pieces[1][0] >= pieces[0][1] - 10


@given(st.text("ab \t\r\n ", max_size=60))
def test_longest_run(t):
    assert s.longest_run(s.points(t)) == max(map(len, re.split(r"[ \t\r\n]", t)))


def test_table(spark, rows_of):
    docs = spark.createDataFrame(
        [("big", "md", "x y " * 100, 1), ("hard", "txt", "z" * 50, 2), ("small", "md", "tiny", 3), ("none", "md", None, 4), ("empty", "md", "", 5), ("free", None, "q" * 99, 6), ("other", "pdf", "r " * 99, 7), ("long", "md", "w " * 200_000, 8)],
        "source_identity string, file_type string, content string, max_chars int",
    )
    limits = spark.createDataFrame([("md", 100, 20), ("txt", 20, 5)], "file_type string, max_chars int, overlap_chars int")
    out = s.split_oversized(docs, limits)
    per = {r[0]: r[1] for r in out.groupBy("source_identity").count().collect()}
    assert set(per) == {"big", "hard", "small", "free", "other", "long"} and per["small"] == per["free"] == per["other"] == 1 and per["long"] > 4000
    assert rows_of(s.oversized_findings(docs, limits)) == [("big", "oversized"), ("hard", "oversized"), ("hard", "unbreakable"), ("long", "oversized")]
    assert s.split_oversized(docs.limit(0), limits).count() == 0
    assert s.split_oversized(docs, limits.limit(0)).count() == 6
