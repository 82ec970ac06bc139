"""Sizes of texts in tokens of a public tokenizer. Vocabularies are read from a path, never trained."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabularies part a text before merging (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a vocabulary file, loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of tokens of each text; 0 for null and empty texts."""
    rows = docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b["__text"]]
            yield b.drop(columns="__text").assign(tokens=sizes)

    return rows.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "tokens long"])).withColumn("tokens", F.col("tokens").cast("long"))
