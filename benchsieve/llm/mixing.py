"""Problem 8: mixing sources to target weights.

Each source gets a quota of tokens; whole passes over a source and a part of it
in the order of a hash fill the quota. The copies are dealt to output shards by
a splitting tree: the vector of copies per source is split in two by draws from
the multivariate hypergeometric distribution, again and again, down to one
shard; each source's copies in permuted order are cut into disjoint blocks of
these sizes, and every shard is shuffled by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import batched
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from benchsieve.llm.tokens import TOKENIZER, count_tokens
from benchsieve.llm.prefix import BUCKETS, hash_bucket, running_total
from benchsieve.session import stage_table

#: Tokens in an output shard, about.
SHARD_TOKENS = 1_000_000
#: Nodes of the splitting tree that the driver makes; the rest is split in tasks.
SUBTREES = 256
#: Ranks in a bin, by which copies and shards are joined.
BIN = 4096
#: Most rows of targets, which are held by the driver.
MOST_SOURCES = 100_000


def quotas(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """One entry per target source: tokens and documents there are, share, quota, and why it falls short if so.

    Shares of sources without tokens are spread over the others in proportion.
    Without ``total_tokens`` the mixture is as large as the scarcest source lets
    it be with every share met; a larger total leaves scarce sources short.
    """
    if targets.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} rows of targets")
    have = {r["source"]: (r["tokens"], r["docs"]) for r in counted.join(F.broadcast(targets.select(F.col("source_name").alias("source")).distinct()), "source").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    rows = [{"source": r["source_name"], "target_share": r["target_share"], "max_repeats": r["max_repeats"]} for r in targets.groupBy("source_name").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect() if r["source_name"] is not None]
    for r in rows:
        r["tokens"], r["docs"] = have.get(r["source"], (0, 0))
        r["target_share"], r["max_repeats"] = r["target_share"] or 0.0, r["max_repeats"] or 0
    live = sum(r["target_share"] for r in rows if r["tokens"] and r["max_repeats"])
    for r in rows:
        r["share"] = r["target_share"] / live if r["tokens"] and r["max_repeats"] and live else 0.0
    most = min((r["tokens"] * r["max_repeats"] / r["share"] for r in rows if r["share"]), default=0)
    total = most if total_tokens is None else total_tokens
    for r in rows:
        want = r["share"] * total
        r["quota"] = min(want, r["tokens"] * r["max_repeats"])
        r["status"] = "missing" if not r["tokens"] else "short" if r["quota"] < want * (1 - 1e-9) else "met"
    return rows


def uses(counted: DataFrame, plan: list[dict], seed: int = 0) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``uses`` for every document; 0 where its source is no target.

    ``uses`` differs by at most one within a source and never exceeds its
    ``max_repeats``. The part pass takes documents in the order of a hash; those
    that alone would be over a fiftieth of what is left wait until the others
    are used up, and come from small to large, so that one long document does
    not spoil a small quota. It ends where a document's middle would pass it.
    """
    spark = counted.sparkSession
    table = spark.createDataFrame(
        [(r["source"], int(r["quota"] // r["tokens"]) if r["tokens"] else 0, float(r["quota"] % r["tokens"]) if r["tokens"] else 0.0, r["max_repeats"]) for r in plan],
        "source string, passes int, rest double, most int",
    )
    known = counted.join(F.broadcast(table), "source", "left").withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")), 256))
    late = F.col("n_tokens") > F.col("rest") / 50
    size = F.when(late, F.col("n_tokens")).otherwise(0)
    bucket = F.when(late, BUCKETS + F.floor(F.log2(F.greatest("n_tokens", F.lit(1))) * 64)).otherwise(hash_bucket("h")).cast("int")
    mixed = running_total(known.where("passes is not null").withColumn("size", size), ["source"], ["size", "h"], F.col("n_tokens"), "before", bucket)
    extra = F.when(F.col("before") + F.col("n_tokens") / 2 < F.col("rest"), 1).otherwise(0)
    n = F.least(F.col("passes") + extra, F.col("most"))
    return mixed.select("doc_id", "source", "n_tokens", n.alias("uses")).unionByName(known.where("passes is null").select("doc_id", "source", "n_tokens", F.lit(0).alias("uses")))


class Node(NamedTuple):
    """A part of the splitting tree: shards from ``left`` up to ``right``, the copies of each source in them, and those in earlier shards."""

    left: int
    right: int
    number: int
    have: list[int]
    before: list[int]


def split_node(node: Node, seed: int) -> tuple[Node, Node]:
    """The two halves of a node; how many copies of each source fall to the left one is a multivariate hypergeometric draw."""
    mid = (node.left + node.right) // 2
    rest = sum(node.have)
    need = rest * (mid - node.left) // (node.right - node.left)
    rng = np.random.default_rng([seed, node.number])
    part = [0] * len(node.have)
    for i, h in enumerate(node.have):  # one after the other, so that totals over 10^9 are no bar
        if need <= 0 or rest <= 0:
            break
        others = rest - h
        if max(h, others) < 1_000_000_000:
            part[i] = int(rng.hypergeometric(h, others, need)) if h and others else min(h, need)
        else:
            sd = math.sqrt(need * (h / rest) * (others / rest) * ((rest - need) / max(1, rest - 1)))
            part[i] = min(h, need, max(need - others, 0, round(need * h / rest + sd * rng.standard_normal())))
        need -= part[i]
        rest -= h
    return (
        Node(node.left, mid, 2 * node.number, part, node.before),
        Node(mid, node.right, 2 * node.number + 1, [h - p for h, p in zip(node.have, part)], [b + p for b, p in zip(node.before, part)]),
    )


def leaves(node: Node, seed: int) -> Iterator[Node]:
    """The shards under a node, in order."""
    todo = [node]
    while todo:
        n = todo.pop()
        if n.right - n.left == 1:
            yield n
        else:
            todo += split_node(n, seed)[::-1]


def shard_quotas(spark: SparkSession, sources: list[str], copies: list[int], shards: int, seed: int = 0) -> DataFrame:
    """``source``, ``shard``, ``start``, ``n``: which copies of a source, in permuted order, belong to a shard.

    The driver splits the tree down to ``SUBTREES`` nodes at most; the trees
    under them grow in tasks, since a node's draw depends on its number alone.
    Shards are of equal size but for one copy.
    """
    top = [Node(0, shards, 1, copies, [0] * len(copies))]
    while len(top) < min(shards, SUBTREES):
        top = [x for n in top for x in (split_node(n, seed) if n.right - n.left > 1 else (n,))]
    roots = spark.createDataFrame([(n.left, n.right, n.number, n.have, n.before) for n in top], "left bigint, right bigint, number bigint, have array<bigint>, before array<bigint>")
    roots = roots.repartition(min(len(top), spark.sparkContext.defaultParallelism), "number")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                for block in batched(leaves(Node(r.left, r.right, r.number, list(map(int, r.have)), list(map(int, r.before))), seed), 4096):
                    rows = [(s, x.left, x.before[i], x.have[i]) for x in block for i, s in enumerate(sources) if x.have[i]]
                    yield pd.DataFrame(rows, columns=["source", "shard", "start", "n"])

    return roots.mapInPandas(grow, "source string, shard bigint, start bigint, n bigint")


def arrange(used: DataFrame, shard_tokens: int = SHARD_TOKENS, seed: int = 0) -> DataFrame:
    """``shard``, ``position``, ``doc_id``, ``copy``, ``source``, ``n_tokens``: every use of every document placed once.

    Copies and shards meet by equal bins of ranks, so nothing that grows with
    the number of shards is broadcast.
    """
    spark = used.sparkSession
    per = used.where("uses > 0").groupBy("source").agg(F.sum("uses").alias("copies"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens")).orderBy("source").collect()
    if not per:
        return spark.createDataFrame([], "shard bigint, position int, doc_id bigint, copy int, source string, n_tokens bigint")
    shards = max(1, math.ceil(sum(r["tokens"] for r in per) / shard_tokens))
    quota = shard_quotas(spark, [r["source"] for r in per], [r["copies"] for r in per], shards, seed)
    bins = quota.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("start") + F.col("n") - 1) / BIN))))
    rows = used.where("uses > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("copy"))
    rows = rows.withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(seed + 1)), F.col("doc_id").cast("string"), F.col("copy").cast("string")), 256))
    ranked = running_total(rows, ["source"], ["h"], F.lit(1), "rank", hash_bucket("h")).withColumn("bin", F.floor(F.col("rank") / BIN))
    placed = ranked.join(bins, ["source", "bin"]).where("rank >= start and rank < start + n")
    order = Window.partitionBy("shard").orderBy(F.xxhash64("h"), "h")
    return placed.select("shard", (F.row_number().over(order) - 1).alias("position"), "doc_id", "copy", "source", "n_tokens")


def counted_uses(used: DataFrame, arranged: DataFrame) -> DataFrame:
    """``used`` with ``uses`` as the shards of the mixture have them, 0 where no shard holds a document."""
    got = arranged.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("uses"))
    return used.drop("uses").join(got, "doc_id", "left").fillna(0, ["uses"])


def share_report(used: DataFrame, plan: list[dict]) -> DataFrame:
    """Per target source: documents, tokens there are, used and unused, uses, target and actual share, and whether the quota was met.

    ``tokens_unused`` are those of documents that are not used at all.
    """
    spark = used.sparkSession
    table = spark.createDataFrame([(r["source"], float(r["target_share"]), float(r["share"]), int(r["max_repeats"]), r["status"]) for r in plan], "source string, target_share double, share_aimed double, max_repeats int, status string")
    got = used.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens_used"),
        F.sum(F.when(F.col("uses") == 0, F.col("n_tokens")).otherwise(0)).alias("tokens_unused"), F.max("uses").alias("most_uses"),
    )
    out = F.broadcast(table).join(got, "source", "left").fillna(0, ["n_docs", "tokens", "tokens_used", "tokens_unused", "most_uses"])
    return out.withColumn("actual_share", F.try_divide("tokens_used", F.sum("tokens_used").over(Window.partitionBy())))


def count(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, written once."""
    return stage_table(count_tokens(documents, ["doc_id", "source"], path=path), "counted")


def mix(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """The uses of every counted document, and the plan they follow.

    Sources are compared as spelled; documents without a source or of a source
    that is no target are used 0 times; repeated target rows count once; empty
    texts have no tokens and ride along with their source's passes; an empty
    table gives no rows.
    """
    plan = quotas(counted, targets, total_tokens)
    return uses(counted, plan, seed), plan
