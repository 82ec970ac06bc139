from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from granary.operators.diff import canonical_json, diff
from pyspark.sql import functions as F

KIND = "k string, a string, b int, m string, extra string"
VERSIONED = "k string, a string, b int, m string, v timestamp, side string"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_differences_by_field(spark):
    left = spark.createDataFrame([("1", "x", 1, '{"a":1}', "e"), ("2", None, 2, "{}", ""), ("3", "y", 3, None, ""), (None, "z", 0, "{}", "")], KIND)
    right = spark.createDataFrame(
        [("1", "x", 1, '{ "p": 2, "a" : 1 }', datetime(2020, 1, 2), ""), ("1", "old", 9, "{}", datetime(2020, 1, 1), ""), ("2", "", 2, "{}", None, ""), ("4", "q", 4, "{}", None, ""), (None, "", 0, "", None, "")],
        VERSIONED,
    )
    found = diff(left, right, "k", ["a", "b", "m"], right_version="v", json_fields={"m": ["p"]})
    assert got(found) == [("2", "a"), ("3", "only_in_left"), ("4", "only_in_right"), (None, "only_in_left"), (None, "only_in_right")]


def test_null_keys_match_one_for_one(spark):
    left = spark.createDataFrame([(None, "x", 1, "{}", "")] * 3 + [(None, "y", 1, "{}", "")], KIND)
    right = spark.createDataFrame([(None, "x", 1, "{}", "")], KIND)
    assert got(diff(left, right, "k", ["a", "b"])) == [(None, "only_in_left")] * 3


def test_superseded_versions_in_equal_ranges(spark):
    left = spark.createDataFrame([(str(i), "x", i, "{}", "") for i in range(200)], KIND)
    old = [(str(i), "old", i, "{}", datetime(2020, 1, 1), "") for i in range(0, 200, 3)]
    right = spark.createDataFrame(old + [(str(i), "x" if i != 9 else "z", i, "{}", datetime(2020, 1, 2), "") for i in range(200)], VERSIONED)
    assert got(diff(left, right, "k", ["a", "b"], right_version="v", bits_per_level=3)) == [("9", "a")]


def test_equal_and_empty_sides(spark):
    rows = spark.createDataFrame([(str(i), "x" * i, i, "{}", "") for i in range(40)], KIND)
    assert got(diff(rows, rows, "k", ["a", "b"])) == []
    assert got(diff(rows, rows.unionByName(rows), "k", ["a", "b"])) == []  # repeated rows count once
    none = rows.limit(0)
    assert len(got(diff(rows, none, "k", ["a"]))) == 40
    assert got(diff(none, none, "k", ["a"])) == []


def test_canonical_json(spark):
    texts = ['{"b":1,"a":{"y":2,"x":"\\u00e9"}}', '{ "a": {"x": "é", "y": 2}, "b": 1 }', '{"b":"1","a":{"y":2,"x":"é"}}', "[2, 1]", "not json", None, '{"gone": 1}', "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = [r[0] for r in df.select(canonical_json(F.col("t"), ["gone"]), "i").orderBy("i").collect()]
    assert out[0] == out[1] != out[2]
    assert out[3:6] == ["[2,1]", "not json", None]
    assert out[6] == out[7]


cells = st.one_of(st.none(), st.sampled_from(["", "a", "b"]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 30), st.tuples(cells, cells)), st.dictionaries(st.integers(0, 30), st.tuples(cells, cells)))
def test_against_brute_force(spark, a, b):
    frame = lambda d: spark.createDataFrame([(str(k), *v) for k, v in d.items()], "k string, x string, y string")
    want = [(str(k), "only_in_left") for k in a.keys() - b.keys()] + [(str(k), "only_in_right") for k in b.keys() - a.keys()]
    want += [(str(k), f) for k in a.keys() & b.keys() for i, f in enumerate("xy") if a[k][i] != b[k][i]]
    assert got(diff(frame(a), frame(b), "k", ["x", "y"])) == sorted(want, key=str)
