"""Records that differ in layout only: progressive partition refinement.

Every record first gets invariants that cost little: whether it is a card, its stripped
length (letters and digits after NFC and lower-casing) and a hash of its letter
histogram. Records alone in their class cannot have a copy and are done. Only the
members of classes with several get the costlier key, a 128-bit hash of the word
sequence or, for cards, of the sorted collection of fields.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.words import WORD, normal, words
from granary.session import materialize

#: What parts the fields of a card: line breaks, ``;`` and ``|``.
FIELD_BREAK = re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029;|]+")
_ASCII = np.array([c for c in range(128) if chr(c).isalnum()])


def invariants(text: str) -> tuple[int, int]:
    """Stripped length and a hash of the histogram of letters and digits."""
    plain = normal(text)
    counts = np.bincount(np.frombuffer(plain.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)[_ASCII]
    length, other = int(counts.sum()), 0
    if not plain.isascii():
        rest = "".join(sorted(c for c in plain if c > "\x7f" and c.isalnum()))
        length, other = length + len(rest), len(rest)
    data = counts.astype("<u4").tobytes() + (rest.encode("utf-8", "surrogatepass") if other else b"")
    return length, int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def layout_key(text: str, card: bool) -> bytes:
    """128-bit hash of what is left when layout is ignored."""
    if card:
        fields = sorted(" ".join(x) for x in map(words, FIELD_BREAK.split(text)) if x)
        data = "\n".join(["card", *fields])
    else:
        data = "\n".join(["text", " ".join(WORD.findall(normal(text)))])
    return blake2b(data.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _invariants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        both = [invariants(t) for t in b["text"]]
        yield pd.DataFrame({"id": b["id"], "card": b["card"], "length": [x[0] for x in both], "letters": [x[1] for x in both]})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"id": b["id"], "key": [layout_key(t, c) for t, c in zip(b["text"], b["card"])]})


def copy_classes(df: DataFrame, id_col: str, text_col: str, is_card: Column) -> DataFrame:
    """``(rep, id, copies)`` for every record that has a copy, the class's smallest id itself included.

    ``copies`` is the number of records of the class. Records with a null id or text, and
    texts without a letter or digit, are copies of nothing. Repeated rows (same id, same
    words) count once; an id that comes with several texts belongs to the class of each.
    A null ``is_card`` means no card. Extra columns are ignored.
    """
    base = df.where(df[id_col].isNotNull() & df[text_col].isNotNull()).select(
        df[id_col].alias("id"), df[text_col].alias("text"), F.coalesce(is_card, F.lit(False)).alias("card")
    )
    kind = dict(base.dtypes)["id"]
    cheap = base.mapInPandas(_invariants, f"id {kind}, card boolean, length int, letters long").where("length > 0")
    cheap = materialize(cheap, "layout-invariants")
    # A class by letters lies within one by length, so one pass over the ids refines by both.
    classes = cheap.groupBy("card", "length", "letters").count().where("count > 1").drop("count")
    members = cheap.join(classes, ["card", "length", "letters"], "left_semi").select("id").distinct()
    keyed = base.join(members, "id", "left_semi").mapInPandas(_keys, f"id {kind}, key binary")
    keyed = materialize(keyed.distinct(), "layout-keys")
    groups = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    return keyed.join(groups, "key").select("rep", "id", "copies")


def found_copies(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", type_col: str = "resource_type") -> DataFrame:
    """``(copy_rep, chunk_id)``: each record that has a copy with a smaller id, and the smallest."""
    pairs = copy_classes(df, id_col, text_col, df[type_col] == "card")
    return pairs.where("id <> rep").select(F.col("rep").alias("copy_rep"), F.col("id").alias("chunk_id"))


def kept_records(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", type_col: str = "resource_type") -> DataFrame:
    """``(chunk_id, copies)``: one kept record per distinct one, and how many rows it stands for."""
    pairs = copy_classes(df, id_col, text_col, df[type_col] == "card")
    dropped = pairs.where("id <> rep").select(F.col("id").alias("gone"))
    sizes = pairs.where("id = rep").select(F.col("rep"), "copies")
    ids = df.where(df[id_col].isNotNull()).select(df[id_col].alias("chunk_id")).distinct()
    kept = ids.join(dropped, ids["chunk_id"] == dropped["gone"], "left_anti")
    return kept.join(sizes, kept["chunk_id"] == sizes["rep"], "left").select("chunk_id", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
