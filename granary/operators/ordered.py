"""Computations along the order of a document that no single task has to make.

A document's rows are cut into blocks of consecutive positions; each block is worked on by
itself, and one row per block carries results across block edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions in a block.
BLOCK = 10_000


def order(index: str = "doc_chunk_index", id_col: str = "chunk_id") -> list[Column]:
    """Document order: rows without a position come last."""
    return [F.col(index).asc_nulls_last(), F.col(id_col).asc()]


def _blocked(rows: DataFrame, index: str, block: int) -> DataFrame:
    return rows.withColumn("__block", F.coalesce(F.floor(F.col(index) / block), F.lit(1 << 40)))


def _key(index: str, id_col: str) -> Column:
    return F.struct(F.col(index).isNull().alias("n"), F.col(index).alias("i"), F.col(id_col).alias("c"))


def carry(rows: DataFrame, value: Column, name: str, doc: str = "doc_id", index: str = "doc_chunk_index", id_col: str = "chunk_id", block: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``: the last non-null ``value`` in earlier rows of the document."""
    rows = _blocked(rows, index, block).withColumn("__value", value)
    inside = Window.partitionBy(doc, "__block").orderBy(*order(index, id_col)).rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where("__value is not null").groupBy(doc, "__block").agg(F.max_by("__value", _key(index, id_col)).alias("last"))
    blocks = rows.select(doc, "__block").distinct().join(last, [doc, "__block"], "left")
    over = Window.partitionBy(doc).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.last("last", ignorenulls=True).over(over)).drop("last")
    within = rows.withColumn("__within", F.last("__value", ignorenulls=True).over(inside))
    return within.join(blocks, [doc, "__block"]).withColumn(name, F.coalesce("__within", "__before")).drop("__block", "__value", "__within", "__before")


def around(rows: DataFrame, doc: str = "doc_id", index: str = "doc_chunk_index", id_col: str = "chunk_id", block: int = BLOCK) -> DataFrame:
    """``(chunk_id, prev, next, position, doc_chunks)``; ``''`` where there is no neighbour, positions from 0."""
    rows = _blocked(rows.select(doc, index, id_col), index, block)
    inside = Window.partitionBy(doc, "__block").orderBy(*order(index, id_col))
    key = _key(index, id_col)
    ends = rows.groupBy(doc, "__block").agg(F.min_by(id_col, key).alias("first"), F.max_by(id_col, key).alias("last"), F.count("*").alias("n"))
    over = Window.partitionBy(doc).orderBy("__block")
    ends = ends.select(
        doc, "__block", F.lag("last").over(over).alias("b"), F.lead("first").over(over).alias("a"),
        F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy(doc)).alias("doc_chunks"),
    )
    rows = rows.select(doc, "__block", id_col, F.lag(id_col).over(inside).alias("p"), F.lead(id_col).over(inside).alias("q"), F.row_number().over(inside).alias("r"))
    rows = rows.join(ends, [doc, "__block"])
    return rows.select(
        id_col, F.coalesce("p", "b", F.lit("")).alias("prev"), F.coalesce("q", "a", F.lit("")).alias("next"), (F.col("ahead") + F.col("r") - 1).alias("position"), "doc_chunks",
    )


def following(rows: DataFrame, columns: list[str], doc: str = "doc_id", index: str = "doc_chunk_index", id_col: str = "chunk_id", block: int = BLOCK) -> DataFrame:
    """``rows`` with ``next_<column>`` of the next row of the document."""
    rows = _blocked(rows, index, block)
    inside = Window.partitionBy(doc, "__block").orderBy(*order(index, id_col))
    value = F.struct(*columns)
    firsts = rows.groupBy(doc, "__block").agg(F.min_by(value, _key(index, id_col)).alias("first"))
    firsts = firsts.select(doc, "__block", F.lead("first").over(Window.partitionBy(doc).orderBy("__block")).alias("__after"))
    out = rows.withColumn("__next", F.lead(value).over(inside)).join(firsts, [doc, "__block"])
    return out.select("*", *[F.coalesce("__next", "__after")[c].alias(f"next_{c}") for c in columns]).drop("__next", "__after", "__block")
