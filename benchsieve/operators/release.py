"""Release statistics, paper-disjoint views, the greedy split and integrity checks."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.ids import paper_key


def year_month(paper: str | Column) -> Column:
    """``y*100+m`` of a paper id in the form YYMM.NNNNN; null if it has none."""
    k = paper_key(paper)
    yy, m = F.substring(k, 1, 2).try_cast("int"), F.substring(k, 3, 2).try_cast("int")
    return F.when(m.between(1, 12), F.when(yy < 90, 2000 + yy).otherwise(1900 + yy) * 100 + m)


def era(ym: str) -> Column:
    y = F.floor(F.col(ym) / 100)
    return F.when(y <= 2018, "to 2018").when(y <= 2023, "2019 to 2023").when(y.isNotNull(), "from 2024")


def pct(a: Column, b: Column) -> Column:
    return F.bround(100 * a / b, 3)


def split_key(c: str = "split") -> Column:
    return F.lower(F.trim(c))


def disjoint_view(problems: DataFrame) -> DataFrame:
    """``problem_id``, ``paper``, ``type`` of test problems whose paper no train problem shares; those without a paper are left out."""
    rows = problems.select("problem_id", paper_key("paper_id").alias("paper"), "type", split_key().alias("s"))
    train = rows.where("s = 'train' and paper is not null").select("paper").distinct()
    return rows.where("s = 'test' and paper is not null").join(train, "paper", "left_anti").select("problem_id", "paper", "type")


def paper_classes(problems: DataFrame) -> DataFrame:
    """``class`` (both, train only, test only, other) and the number of papers in it."""
    rows = problems.select(paper_key("paper_id").alias("paper"), split_key().alias("s")).where("paper is not null")
    have = rows.groupBy("paper").agg(F.max((F.col("s") == "train").cast("int")).alias("tr"), F.max((F.col("s") == "test").cast("int")).alias("te"))
    tr, te = F.coalesce("tr", F.lit(0)) == 1, F.coalesce("te", F.lit(0)) == 1
    kind = F.when(tr & te, "both").when(tr, "train only").when(te, "test only").otherwise("other")
    return have.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n_papers"))


def type_split_counts(problems: DataFrame) -> DataFrame:
    """Counts by split, by type and by both in one pass; a null key of an outer level stands as '*'."""
    s, t = F.coalesce(split_key(), F.lit("none")), F.coalesce("type", F.lit("none"))
    rows = problems.select(s.alias("split"), t.alias("type"))
    g = rows.cube("split", "type").agg(F.grouping("split").alias("gs"), F.grouping("type").alias("gt"), F.count(F.lit(1)).alias("n"))
    return g.select(F.when(F.col("gs") == 1, "*").otherwise(F.col("split")).alias("split"), F.when(F.col("gt") == 1, "*").otherwise(F.col("type")).alias("type"), "n")


def target_vector(problems: DataFrame, fraction: float = 0.2) -> DataFrame:
    """``type`` and the number of its problems that a test share of ``fraction`` aims at."""
    per = problems.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    total = problems.agg(F.count(F.lit(1)).alias("total"))
    return per.join(F.broadcast(total)).select("type", "n", (F.bround(F.col("total") * fraction, 0) * F.col("n") / F.col("total")).alias("target"))


def greedy_split(problems: DataFrame, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """``problem_id``, ``paper``, ``split``: whole papers go to test one by one until the target is met.

    Each step takes the paper that brings the counts by type closest to the
    target (then the total, then the least hash). The steps depend on each
    other, so they run on the driver over one small vector a paper; all counts
    are kept as integers scaled by the total, so ties do not hang on rounding.
    """
    rows = problems.select("problem_id", F.coalesce(paper_key("paper_id"), F.lit("none")).alias("paper"), F.coalesce("type", F.lit("")).alias("type"))
    table = rows.groupBy("paper", "type").count().collect()
    if not table:
        return rows.select("problem_id", "paper", F.lit("train").alias("split"))
    types = sorted({r["type"] for r in table})
    at = {t: i for i, t in enumerate(types)}
    have: dict[str, list[int]] = {}
    for r in table:
        have.setdefault(r["paper"], [0] * len(types))[at[r["type"]]] += r["count"]
    total = sum(map(sum, have.values()))
    target = int(round(total * fraction))
    aim = [target * sum(v[i] for v in have.values()) for i in range(len(types))]  # scaled by total
    key = {p: hashlib.sha256(f"{seed}:{p}".encode()).hexdigest() for p in have}
    papers = sorted(have, key=key.get)  # on ties the first wins, which has the least hash
    counts = np.array([have[p] for p in papers], dtype=np.int64)
    sizes, aims = counts.sum(1), np.array(aim, dtype=np.int64)
    free, now, chosen = np.ones(len(papers), dtype=bool), np.zeros(len(types), dtype=np.int64), []
    while free.any() and now.sum() < target:
        at_free = np.flatnonzero(free)
        off = np.abs((now + counts[at_free]) * total - aims).sum(1)
        near = at_free[off == off.min()]
        miss = np.abs(now.sum() + sizes[near] - target)
        best = int(near[miss == miss.min()][0])
        free[best] = False
        chosen.append(papers[best])
        now = now + counts[best]
    picked = problems.sparkSession.createDataFrame([(p,) for p in chosen], "paper string").withColumn("t", F.lit(1))
    return rows.join(F.broadcast(picked), "paper", "left").select("problem_id", "paper", F.when(F.col("t") == 1, "test").otherwise("train").alias("split"))


def relabelled(problems: DataFrame, assigned: DataFrame) -> DataFrame:
    """``problems`` with ``original_split`` kept and ``split`` replaced."""
    return problems.withColumnRenamed("split", "original_split").join(assigned.select("problem_id", "split"), "problem_id", "left")


def id_mismatch(a: DataFrame, b: DataFrame, key: str = "problem_id") -> DataFrame:
    """How many distinct keys are in one of the tables only, and in both."""
    x, y = a.select(F.col(key).alias("k")).distinct().withColumn("x", F.lit(1)), b.select(F.col(key).alias("k")).distinct().withColumn("y", F.lit(1))
    j = x.join(y, "k", "full_outer")
    return j.agg(F.count(F.when(F.col("y").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("x").isNull(), 1)).alias("only_right"), F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("both"))


def view_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one view and not in the other, with their side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def file_manifest(df_binary: DataFrame) -> DataFrame:
    """``name``, ``bytes``, ``sha256`` of files read with the binaryFile source."""
    return df_binary.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def part_sums(parts: DataFrame, whole: str, part: str, total: int) -> DataFrame:
    """Whether the counts ``part`` of the rows add up to ``total``: ``whole``, ``sum``, ``expected``, ``ok``."""
    n = F.coalesce(F.sum(part), F.lit(0))
    return parts.agg(F.lit(whole).alias("whole"), n.alias("sum"), F.lit(total).alias("expected"), (n == total).alias("ok"))
