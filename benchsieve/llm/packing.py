"""Problem 7: packing documents into sequences of a fixed number of tokens.

Harmonic packing: a piece of size in (capacity/(k+1), capacity/k] belongs to
class k, and a sequence of class k takes k of its pieces, a fixed count. Workers
pack shards of a bounded number of pieces, dealt by hash, independently of each
other. Plain harmonic packing leaves the rest of each sequence empty; here the
rest is topped up with the largest smaller pieces of the shard that still fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchsieve.llm.tokens import TOKENIZER, count_tokens

CAPACITY = 2048
#: Pieces in a shard, about.
SHARD_PIECES = 8192


def pieces(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``piece_no``, ``token_start``, ``n_tokens``: documents over ``capacity`` in pieces, others whole, empty ones not at all."""
    n = F.ceil(F.col("n_tokens") / capacity).cast("int")
    some = lengths.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece_no"))
    start = F.col("piece_no") * F.lit(capacity).cast("bigint")
    return some.select("doc_id", "piece_no", start.alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - start).alias("n_tokens"))


def pack_shard(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and place in it of each of ``sizes``, none of which exceeds ``capacity``."""
    n = len(sizes)
    seq, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32)
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(sizes, kind="stable")[::-1]:
        stock[sizes[i]].append(int(i))
    under = list(range(capacity + 1))  # under[s]: the largest size up to s in stock, found with path halving
    for s in range(1, capacity + 1):
        if not stock[s]:
            under[s] = s - 1

    def fit(s: int) -> int:
        while under[s] != s:
            under[s] = under[under[s]]
            s = under[s]
        return s

    def take(s: int) -> int:
        i = stock[s].pop()
        if not stock[s]:
            under[s] = s - 1
        return i

    bins = 0
    for k in range(1, capacity + 1):
        top, least = capacity // k, capacity // (k + 1) + 1
        while True:
            s = fit(top)
            if s < least:
                break
            room, at = capacity, 0
            for _ in range(k):  # the fixed count of the class
                s = fit(min(top, room))
                if s < least:
                    break
                i = take(s)
                seq[i], place[i] = bins, at
                room -= s
                at += 1
            while room:  # the rest
                s = fit(room)
                if s == 0:
                    break
                i = take(s)
                seq[i], place[i] = bins, at
                room -= s
                at += 1
            bins += 1
    return seq, place


def pack(documents: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, path: str = TOKENIZER) -> DataFrame:
    """``sequence_id``, ``position``, ``offset``, ``doc_id``, ``piece_no``, ``token_start``, ``n_tokens``.

    A document is divided only if it alone exceeds ``capacity``. Null and empty
    texts take no place; repeated texts are packed each (``doc_id`` tells rows
    apart); an empty table gives no rows. Token counts are the only thing that
    is shuffled, once, by shard.
    """
    from benchsieve.session import stage_table

    rows = stage_table(pieces(count_tokens(documents, ["doc_id"], path=path), capacity), "pieces")
    shards = max(1, math.ceil(rows.count() / shard_pieces))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["doc_id", "piece_no"], kind="stable")
        seq, place = pack_shard(b["n_tokens"].to_numpy(), capacity)
        out = b.assign(sequence_id=seq + (int(key[0]) << 32), position=place).sort_values(["sequence_id", "position"])
        out["offset"] = out.groupby("sequence_id")["n_tokens"].cumsum() - out["n_tokens"]
        return out[["sequence_id", "position", "offset", "doc_id", "piece_no", "token_start", "n_tokens"]]

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, "sequence_id bigint, position int, offset bigint, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, tokens, the fewest sequences that could hold them, and the share of space used."""
    seqs = packed.groupBy("sequence_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("parts"))
    return seqs.agg(
        F.count(F.lit(1)).alias("n_sequences"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / capacity).alias("least_sequences"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"), F.max("parts").alias("most_parts"),
    )
