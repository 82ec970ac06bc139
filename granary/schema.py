"""Row types and the checks of required fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("source_file", T.StringType()),
    T.StructField("doc_chunk_index", T.IntegerType()), T.StructField("global_index", T.LongType()), T.StructField("char_start", T.IntegerType()),
    T.StructField("char_end", T.IntegerType()), T.StructField("content_module_id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("metadata", T.StringType()),
])
CHUNK_COLUMNS = CHUNK.fieldNames()
REQUIRED = ("chunk_id", "doc_id", "source_file", "doc_chunk_index", "text")
SOURCE_COLUMNS = ["source_identity", "source_fingerprint", "relative_path", "filename", "file_type"]


def contract_violations(chunks: DataFrame) -> DataFrame:
    """``(rule, violations)``: one row per rule a chunk table breaks, from two aggregates.

    Rules: each required field present and not empty, ids unique, texts not blank, all or
    no global ordinals, global ordinals unique.
    """
    rules = {f"{f}_missing": F.col(f).isNull() | (F.col(f).cast("string") == "") for f in REQUIRED}
    rules["text_blank"] = F.trim(F.col("text")) == ""
    sums = [F.count_if(test).alias(rule) for rule, test in rules.items()]
    some = F.count("global_index")
    sums.append(F.when((some > 0) & (some < F.count("*")), F.count("*") - some).otherwise(F.lit(0)).alias("global_index_partial"))
    one = chunks.agg(*sums)
    names = [*rules, "global_index_partial"]
    flat = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("violations")) for n in names])).alias("x")).select("x.*")
    for column in ("chunk_id", "global_index"):
        repeated = chunks.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
        flat = flat.unionByName(repeated.select(F.lit(f"{column}_repeated").alias("rule"), F.col("violations").cast("long").alias("violations")))
    return flat.where("violations > 0")


def undense_documents(chunks: DataFrame) -> DataFrame:
    """``(doc_id, chunks, first, last, distinct)`` of documents whose ordinals are not 0..n-1."""
    i = F.col("doc_chunk_index")
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min(i).alias("first"), F.max(i).alias("last"), F.count_distinct(i).alias("distinct"))
    dense = (F.col("first") == 0) & (F.col("last") == F.col("chunks") - 1) & (F.col("distinct") == F.col("chunks"))
    return per.where(~F.coalesce(dense, F.lit(False)))
