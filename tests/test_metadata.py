import json

from granary import cli
from granary.functions import metadata as m
from granary.operators import signals
from granary.sources import datasets_dir
from pyspark.sql import functions as F


def test_shapes(spark):
    raw = ['{"a": 1}', "{'a': None, 'b': [1]}", '{"metadata": "{\\"x\\": 2}"}', "junk", "", None, "[1]", '{"metadata": "{bad"}']
    want = [{"a": 1}, {"a": None, "b": [1]}, {"metadata": {"x": 2}}, {"_raw": "junk"}, {}, {}, {"_raw": "[1]"}, {"metadata": "{bad"}]
    assert [m.parse(r) for r in raw] == want
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    assert [json.loads(r[0]) for r in df.orderBy("i").select(m.normalised(F.col("raw"))).collect()] == want


def test_scalars(spark):
    df = spark.createDataFrame([('{"s": "x", "n": 1, "f": 1.5, "b": true, "l": [1], "o": {}, "z": null}',), (None,), ("junk",)], "m string")
    out = [json.loads(r[0]) for r in df.select(m.scalars(F.col("m"))).collect()]
    assert out == [{"s": "x", "n": 1, "f": 1.5, "b": True}, {}, {}]
    assert m.slug("Hull Survey, 2nd!") == "hull-survey-2nd" and m.slug("--") == "dataset"


def test_directory(tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "c"))
    monkeypatch.delenv(datasets_dir.VARIABLE, raising=False)
    assert datasets_dir.resolve()[1] == "default"
    assert cli.main(["datasets-dir", "--set", str(tmp_path / "d")]) == 0 and datasets_dir.resolve() == (tmp_path / "d", "config")
    monkeypatch.setenv(datasets_dir.VARIABLE, str(tmp_path / "e"))
    assert datasets_dir.resolve()[1] == "environment" and datasets_dir.resolve("x")[1] == "argument"
    (tmp_path / "e/one").mkdir(parents=True)
    (tmp_path / "e/one/dataset.json").write_text("{")
    (tmp_path / "e/other").mkdir()
    assert [e["folder"] for e in datasets_dir.entries()] == ["one"] and datasets_dir.entries()[0]["problem"]
    assert cli.main(["datasets-dir", "--unset", "--json"]) == 0 and "environment" in capsys.readouterr().out and datasets_dir._config() == {}


def test_calls():
    assert signals.calls([3, 3, 3, 20, 1, 1, 1], 10, 3) == [[0, 1, 2], [3], [4, 5, 6]] and signals.calls([]) == []
