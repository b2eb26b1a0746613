"""Connected components by concurrent breadth-first search from many seeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchsieve.session import checkpoint, stage_table

#: A node with more neighbours than this is split into hubs of about this size.
HUB = 10_000
#: Links of a graph of colliding seeds that are merged in one task, some 100 bytes each.
SMALL = 1_000_000


def split_hubs(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """``edges`` (a, b) in which no ``b`` has many more than ``hub`` neighbours ``a``.

    A larger ``b`` stands behind sub-nodes, dealt by hash, that link to it; what
    is connected stays the same and no adjacency list becomes one huge group.
    """
    big = edges.groupBy("b").count().where(F.col("count") > hub).select("b", F.ceil(F.col("count") / hub).alias("parts"))
    e = edges.join(big, "b", "left")
    sub = F.concat_ws("#", "b", F.pmod(F.xxhash64("a"), "parts").cast("string"))
    near = e.select("a", F.when(F.col("parts").isNull(), F.col("b")).otherwise(sub).alias("b"))
    return near.unionByName(e.where("parts is not null").select(sub.alias("a"), "b").distinct())


def _one_level(adjacency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seed label of each node, and the pairs of seeds whose searches met.

    A node is a seed if its hash is below that of all its neighbours: from any
    node, smaller hashes lead down to a seed, so every node is reached and the
    searches stay short. All frontiers move one step a round: they are dealt to
    where the adjacency of their nodes lies, and what they reach meets what was
    visited in one shuffle.
    """
    h = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    seeds = adjacency.groupBy("src").agg(F.min(h("dst")).alias("least")).where(F.col("least") > h("src")).select(F.col("src").alias("node"), F.col("src").alias("label"))
    visited = frontier = stage_table(seeds, "seeds")
    met: list[DataFrame] = []
    while True:
        reached = adjacency.join(frontier, adjacency["src"] == frontier["node"]).select(F.col("dst").alias("node"), "label")
        both = reached.select("node", F.col("label").alias("new"), F.lit(None).cast("string").alias("had")).unionByName(visited.select("node", F.lit(None).cast("string").alias("new"), F.col("label").alias("had")))
        step = both.groupBy("node").agg(F.max("had").alias("had"), F.collect_set("new").alias("labels")).where(F.size("labels") > 0)
        step = stage_table(step.select("node", "had", "labels", F.coalesce("had", F.array_min("labels")).alias("keep")), "frontier")
        met.append(step.select(F.col("keep").alias("src"), F.explode("labels").alias("dst")).where("src <> dst"))
        frontier = step.where("had is null").select("node", F.col("keep").alias("label"))
        if frontier.isEmpty():
            break  # all that was reached had been visited
        visited = visited.unionByName(frontier)  # tables already written, so this is no growing plan of work
    pairs = met[0]
    for m in met[1:]:
        pairs = pairs.unionByName(m)
    return visited, pairs


def _merged(pairs: DataFrame) -> DataFrame:
    """``node`` and ``label`` of a graph of at most ``SMALL`` links, merged in one task; the label is the least node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[str, str] = {}

        def find(x: str) -> str:
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batches:
            for x, y in zip(b["src"], b["dst"]):
                x, y = find(x), find(y)
                up[max(x, y)] = min(x, y)
        yield pd.DataFrame({"node": list(up), "label": [find(x) for x in list(up)]}, dtype=object)

    return pairs.coalesce(1).mapInPandas(run, "node string, label string")


def _symmetric(pairs: DataFrame) -> DataFrame:
    both = pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``node`` and ``component`` for every node of ``edges`` (a, b), strings.

    A level searches from many seeds and leaves a much smaller graph of the
    seeds whose searches met. That graph is merged in one task if it has at most
    ``small`` links, else it is searched like the first. Loops, repeated and
    null edges are ignored; no edges give no rows. Every level is written to the
    shared folder; nothing is sent to the driver.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    graph = checkpoint(_symmetric(edges.where("a is not null and b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst"))).repartition(parts, "src"))
    levels: list[DataFrame] = []
    while not graph.isEmpty():
        labels, met = _one_level(graph)
        levels.append(labels)
        met = stage_table(met.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "met")
        if met.limit(small + 1).count() <= small:
            levels.append(stage_table(_merged(met), "merged"))
            break
        graph = checkpoint(_symmetric(met).repartition(parts, "src"))
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    out = levels[0].select("node", F.col("label").alias("component"))
    for lvl in levels[1:]:
        up = lvl.select(F.col("node").alias("component"), F.col("label").alias("up"))
        out = out.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return stage_table(out, "components")
