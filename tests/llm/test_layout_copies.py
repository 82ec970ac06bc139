import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from granary.llm import layout_copies as lc
from pyspark.sql import functions as F

KIND = "chunk_id string, text string, resource_type string, id string, card string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], KIND)


def test_cases(spark, rows_of):
    rows = [
        ("a", "One  two-THREE", "passage"), ("b", "one two three.", None), ("c", "one two three", "card"), ("d", "two: 2; one: 1", "card"), ("e", "One 1\nTWO — 2 |", "card"), ("f", "one 1 two 2", "passage"),
        ("g", "---", "passage"), ("h", "***", "passage"), ("i", "", "passage"), ("j", None, "passage"), (None, "one two three", "passage"), ("k", unicodedata.normalize("NFD", "Café 한국"), "faq"), ("l", "CAFÉ, 한국!", "log"),
        ("m", "onetwothree", "passage"), ("a", "One  two-THREE", "passage"), ("n", "three two one", "passage"), ("o", "---", "card"),
    ]
    df = frame(spark, rows)
    assert rows_of(lc.found_copies(df)) == [("a", "b"), ("d", "e"), ("k", "l")]
    kept = dict(rows_of(lc.kept_records(df)))
    assert kept["a"] == 2 and kept["d"] == 2 and kept["c"] == kept["g"] == kept["j"] == 1 and "b" not in kept


def test_hot_group_and_empty(spark):
    df = spark.range(3000).select(F.format_string("c%05d", "id").alias("chunk_id"), F.when(F.col("id") % 3 == 0, F.lit("Same text")).otherwise(F.concat(F.lit("t "), "id")).alias("text"), F.lit(None).cast("string").alias("resource_type"))
    assert lc.found_copies(df).count() == 999
    assert lc.found_copies(df.limit(0)).count() == 0 and lc.kept_records(df.limit(0)).count() == 0


texts = st.lists(st.sampled_from(["a", "B", "é", "é", "1", " ", ";", "|", "\n", "-", "ß", "İ", "가", "가"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(texts, texts, st.booleans())
def test_invariants_hold_within_classes(a, b, card):
    if lc.layout_key(a, card) == lc.layout_key(b, card):
        assert lc.invariants(a) == lc.invariants(b)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(texts, st.sampled_from(["card", "log"])), min_size=1, max_size=30))
def test_against_brute_force(spark, rows_of, rows):
    named = [(f"c{i:02}", *r) for i, r in enumerate(rows)]

    def words(t):
        out, run = [], ""
        for c in unicodedata.normalize("NFC", t).lower() + " ":
            if unicodedata.category(c)[0] in "LN":
                run += c
            elif run:
                out.append(run)
                run = ""
        return tuple(out)

    def key(t, kind):
        if kind != "card":
            return ("t", words(t))
        fields = t.replace(";", "\n").replace("|", "\n").split("\n")
        return ("c", tuple(sorted(w for f in fields if (w := words(f)))))

    keys = {c: key(t, k) for c, t, k in named if words(t)}
    want = sorted((min(d for d in keys if keys[d] == keys[c]), c) for c in keys if min(d for d in keys if keys[d] == keys[c]) != c)
    assert rows_of(lc.found_copies(frame(spark, named))) == want
