"""Token counts by a public tokenizer given by the path of its rank file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("BENCHSIEVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How a byte-level tokenizer cuts text before it merges bytes; belongs to the rank file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER):
    """The tokenizer, and the bytes of each token; loaded once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int32)
    for token, n in ranks.items():
        sizes[n] = len(token)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``keep`` and ``n_tokens`` for every row; null and empty texts have none. Whole texts are read; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, _ = encoder(path)
        for b in batches:
            out = b.drop(columns="text_in")
            out["n_tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text_in"]]
            yield out

    rows = df.select(*keep, F.col(text_col).alias("text_in"))
    cols = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInPandas(run, f"{cols}, n_tokens bigint")
