from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from granary.llm import term_counts as tc

KIND = "chunk_id string, doc_id string, text string, n int, gram string"
cells = st.lists(st.tuples(st.sampled_from(["d1", "d2", "d3", None]), st.lists(st.sampled_from(["a", "b", "C", "é", "-"]), max_size=9).map(" ".join)), max_size=14)


def brute(rows, most):
    occurrences, docs = Counter(), defaultdict(set)
    for d, t in rows:
        w = [x for x in (t or "").lower().split() if x != "-"]
        for n in range(1, most + 1):
            for i in range(len(w) - n + 1):
                g = (" ".join(w[i : i + n]), n)
                occurrences[g] += 1
                if d is not None:
                    docs[g].add(d)
    return sorted((*g, k, len(docs[g])) for g, k in occurrences.items())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cells)
def test_against_brute_force(spark, rows_of, rows):
    df = spark.createDataFrame([(str(i), d, t, 1, "g") for i, (d, t) in enumerate(rows)], KIND)
    assert rows_of(tc.ngram_counts(df, sizes=None)) == brute(rows, 9)


def test_spread_documents_and_small_blocks(spark, rows_of, monkeypatch):
    monkeypatch.setattr(tc, "ROWS_PER_PART", 7)
    rows = [("hot", f"a b{i % 5} a c") for i in range(120)] + [(f"d{i}", "a b1") for i in range(6)] + [(None, "a z")] * 3 + [("e", None), ("e", "")]
    df = spark.createDataFrame([(str(i), d, t, 1, "g") for i, (d, t) in enumerate(rows)], KIND)
    assert rows_of(tc.ngram_counts(df, sizes=(1, 2))) == brute(rows, 2)


def test_marks(spark, rows_of):
    rows = [(f"d{i}", "every " + ("some " if i < 4 else "") + ("few" if i < 2 else "")) for i in range(20)]
    df = spark.createDataFrame([(str(i), d, t, 1, "g") for i, (d, t) in enumerate(rows)], KIND)
    marks = {r.gram: r.mark for r in tc.marked_terms(df).collect()}
    assert marks == {"every": ["common"], "some": [], "few": ["rare"]}
    assert tc.marked_terms(df.limit(0)).count() == 0


def test_suffix_array_is_sorted_and_prefixes_are_exact():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(40):
        tokens = np.concatenate([np.append(rng.integers(0, 3, rng.integers(0, 12)), -1) for _ in range(6)])
        made = tc.SuffixArray(tokens)
        text = [tuple(tokens[i : i + int(np.argmax(tokens[i:] < 0))].tolist()) for i in made.order]
        assert [t + (9,) for t in text] == sorted(t + (9,) for t in text) and len(text) == (tokens >= 0).sum()
        for a, b, common in zip(text, text[1:], made.common[1:]):
            assert common == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
