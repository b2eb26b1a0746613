"""Problem 4: splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchsieve.functions.ids import author_key, paper_key
from benchsieve.llm.components import components, split_hubs

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
BUCKETS = 1024


def problem_papers(assigned: DataFrame, problems: DataFrame) -> DataFrame:
    """``problem_id`` and ``paper``, one row per paper of a problem in either table.

    A paper id that is null or unreadable in a row is filled from the problem's
    other rows and, failing those, from ``problems``; a problem without any has
    no row.
    """
    own = assigned.select("problem_id", paper_key("paper_id").alias("paper")).where("paper is not null").distinct()
    other = problems.select("problem_id", paper_key("paper_id").alias("paper")).where("paper is not null").distinct()
    return own.unionByName(other.join(own.select("problem_id").distinct(), "problem_id", "left_anti"))


def paper_edges(papers: DataFrame, licences: DataFrame) -> DataFrame:
    """Edges (a, b) between papers and their authors, papers and those they replace, and papers of one problem."""
    lic = licences.select(paper_key("paper_id").alias("paper"), author_key("author_key").alias("author"), paper_key("replaces_id").alias("replaced"))
    by_author = lic.where("paper is not null and author is not null").select(F.concat(F.lit("P"), "paper").alias("a"), F.concat(F.lit("A"), "author").alias("b")).distinct()
    replaced = lic.where("paper <> replaced").select(F.concat(F.lit("P"), "paper").alias("a"), F.concat(F.lit("P"), "replaced").alias("b")).distinct()
    first = papers.groupBy("problem_id").agg(F.min("paper").alias("low"))
    several = papers.join(first, "problem_id").where("paper <> low").select(F.concat(F.lit("P"), "paper").alias("a"), F.concat(F.lit("P"), "low").alias("b")).distinct()
    return split_hubs(by_author).unionByName(replaced).unionByName(several)


def problem_groups(assigned: DataFrame, problems: DataFrame, licences: DataFrame) -> DataFrame:
    """``problem_id``, ``group_id`` (smallest problem of the group) and ``n`` (problems in it).

    Every problem of ``assigned`` gets one row however often it is repeated; one
    without a paper stands alone; rows without a problem_id are ignored.
    """
    papers = problem_papers(assigned, problems)
    comp = components(paper_edges(papers, licences))
    one = papers.groupBy("problem_id").agg(F.concat(F.lit("P"), F.min("paper")).alias("node"))
    ids = assigned.where("problem_id is not null").select("problem_id").distinct()
    placed = (
        ids.join(one, "problem_id", "left")
        .join(comp, "node", "left")
        .select("problem_id", F.coalesce("component", "node", F.concat(F.lit("Q"), "problem_id")).alias("component"))
    )
    groups = placed.groupBy("component").agg(F.min("problem_id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    return placed.join(groups, "component").select("problem_id", "group_id", "n")


def assign_splits(groups: DataFrame, kinds: DataFrame, shares: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """``problem_id``, ``group_id``, ``split``: whole groups in hash order fill the splits to their shares.

    ``kinds`` has ``problem_id`` and ``type``. Groups are strung by their most
    frequent type, so the mix of types stays close; within a type, groups too
    large for half the smallest share come first and go to the first split, the
    rest follow in the order of their hash, and the middle of a group in the
    running total decides its split. Running totals are kept per bucket of the
    hash and added up over the buckets, so no task orders all groups.
    """
    shares = shares or SHARES
    kind = kinds.groupBy("problem_id").agg(F.max("type").alias("type"))
    typed = groups.join(kind, "problem_id", "left").groupBy("group_id", "type").agg(F.count(F.lit(1)).alias("c"))
    g = typed.groupBy("group_id").agg(F.sum("c").alias("n"), F.max_by("type", F.struct("c", F.coalesce("type", F.lit("")).alias("t"))).alias("main"))
    g = g.withColumn("main", F.coalesce("main", F.lit("")))
    totals = g.groupBy("main").agg(F.sum("n").alias("total"))  # one row a type
    g = g.join(F.broadcast(totals), "main")
    big = F.col("n") > F.col("total") * min(shares.values()) / 2
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), "group_id"), 256)
    g = g.withColumn("h", hashed).withColumn("bucket", F.when(big, F.lit(-1)).otherwise(F.conv(F.substring("h", 1, 4), 16, 10).cast("int") % BUCKETS))
    sums = g.groupBy("main", "bucket").agg(F.sum("n").alias("in_bucket"))  # bounded: types times buckets
    before = sums.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("main").orderBy("bucket")) - F.col("in_bucket")).select("main", "bucket", "before")
    w = Window.partitionBy("main", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    g = g.join(F.broadcast(before), ["main", "bucket"]).withColumn("middle", (F.col("before") + F.sum("n").over(w) - F.col("n") / 2) / F.col("total"))
    names = list(shares)
    split = F.lit(names[-1])
    edge = 1.0
    for name in reversed(names[:-1]):
        edge -= shares[names[names.index(name) + 1]]
        split = F.when(F.col("middle") < edge, F.lit(name)).otherwise(split)
    return groups.select("problem_id", "group_id").join(g.select("group_id", split.alias("split")), "group_id").select("problem_id", "group_id", "split")
