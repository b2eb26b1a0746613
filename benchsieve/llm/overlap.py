"""Scanning a table for word sequences of a bounded block of query texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchsieve.llm.words import ShingleIndex

#: Most characters of query text in one block; what is broadcast at once is of this order.
BLOCK_CHARS = 32_000_000


def query_blocks(queries: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[list, bool]]:
    """The rows of ``queries`` (key, text, more texts) in blocks of bounded size.

    ``queries`` is a stated query set, run against all rows block by block; a
    block is what one pass over the scanned table holds in memory. With each
    comes whether it is the last.
    """
    key, *texts = queries.columns
    size = queries.select(F.sum(sum(F.coalesce(F.length(t), F.lit(0)) for t in texts)).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / block_chars))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        rows = part.orderBy(key).collect()
        if rows:
            yield rows, b == blocks - 1


def broadcast_index(spark: SparkSession, rows: list, slots: bool = False) -> Broadcast:
    """A broadcast ``ShingleIndex`` of the second field of ``rows``, keyed by the first; a third field is context."""
    contexts = [r[2] for r in rows] if rows and len(rows[0]) > 2 else []
    return spark.sparkContext.broadcast(ShingleIndex([r[0] for r in rows], [r[1] for r in rows], contexts, slots))
