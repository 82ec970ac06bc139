"""A source too small for its share runs to its cap and ends no mix."""

from granary.llm import mixing as m
from pyspark.sql import functions as F


def test_budget_of_all_sources(spark):
    rows = [(i, "big", 10) for i in range(900)] + [(1000, "tiny", 10)]
    q = m.queue_sizes(spark.createDataFrame(rows, "id long, source string, tokens long"))
    targets = spark.createDataFrame([("x", "big", 0.8, 2), ("x", "tiny", 0.2, 3), ("y", "big", 0.5, 2), ("y", "gone", 0.5, 2)], "mix_id string, source string, target_share double, max_repeats int")
    got = {(r.mix_id, r.source): r for r in m.shares(m.mix(q, targets, budget="sources"), targets).collect()}
    assert got["x", "tiny"].tokens == 30 and got["x", "tiny"].max_copy == 3
    assert abs(got["x", "big"].tokens - (9010 - 30)) <= 10 and abs(got["y", "big"].tokens - 9000) <= 10
    assert got["x", "tiny"].reached_share < 0.01 and got["y", "gone"].tokens == 0


def test_queries_use_their_documents(spark, tmp_path):
    from granary.llm import queries

    text = "several words of a text that stands for many others"
    spark.createDataFrame([*[(i, "big", text) for i in range(50)], (99, "tiny", text)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("x", "big", 0.5, 1), ("x", "tiny", 0.5, 2)], "mix_id string, source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    assert queries.p7_mixed(spark, str(tmp_path)).agg(F.count_distinct("doc_id")).first()[0] > 45
    assert {r.source: r.max_copy for r in queries.p7_shares(spark, str(tmp_path)).collect()} == {"big": 1, "tiny": 2}
