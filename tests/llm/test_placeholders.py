"""Entities whose codes agree in their first 32 bits get different placeholders."""

from granary.llm import personal_data as pd_

#: An earlier, shorter code was the same for both.
PAIR = ("155555021148", "155555060610")


def test_entities_of_one_short_code_stay_apart(spark):
    docs = spark.createDataFrame([(1, f"call +{PAIR[0]} now"), (2, f"call +{PAIR[1]} now")], "doc_id long, text string")
    names = spark.createDataFrame([], "name string, name_kind string")
    out = {r.doc_id: r.text for r in pd_.replace(docs, names, "granary").collect()}
    assert all("[PHONE_" in t for t in out.values()) and out[1] != out[2]
