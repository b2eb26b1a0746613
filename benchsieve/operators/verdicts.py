"""Verdicts of a judge on model responses: scans, null policies and accuracies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = ["B0", "B1", "B2", "B3", "B4"]


def bucket(hits: str | Column) -> Column:
    """B0 to B4 for 0, 1-2, 3-5, 6-10 and more hits; negative counts fall in B4."""
    h = F.col(hits) if isinstance(hits, str) else hits
    return F.when(h == 0, "B0").when(h.between(1, 2), "B1").when(h.between(3, 5), "B2").when(h.between(6, 10), "B3").otherwise("B4")


def scan(raw: DataFrame, keep: str = "last") -> DataFrame:
    """``model``, ``problem_id``, ``is_correct`` (0/1), ``in_s0``, ``in_s1``, ``hits_total``.

    Null verdicts are dropped, missing flags are false and 0. Of several verdicts
    on one pair the last or first by (judged_at, response_id) stays, or all.
    """
    v = raw.where("is_correct is not null")
    if keep != "all":
        order = [F.col("judged_at"), F.col("response_id")]
        pick = F.max_by if keep == "last" else F.min_by
        whole = F.struct("is_correct", "in_s0", "in_s1", "hits_total")
        v = v.groupBy("model", "problem_id").agg(pick(whole, F.struct(*order)).alias("v")).select("model", "problem_id", "v.*")
    return v.select(
        F.trim("model").alias("model"), F.col("problem_id").cast("string").alias("problem_id"), F.col("is_correct").cast("bigint").alias("is_correct"),
        F.coalesce("in_s0", F.lit(False)).alias("in_s0"), F.coalesce("in_s1", F.lit(False)).alias("in_s1"), F.coalesce("hits_total", F.lit(0)).alias("hits_total"),
    )


def null_policies(raw: DataFrame) -> DataFrame:
    """Per model the accuracy with null verdicts dropped and with them counted as wrong."""
    ok = F.sum(F.col("is_correct").cast("bigint"))
    n, judged = F.count(F.lit(1)), F.count("is_correct")
    return raw.groupBy("model").agg(n.alias("n"), (n - judged).alias("n_null"), (ok / judged).alias("acc_dropped"), (F.coalesce(ok, F.lit(0)) / n).alias("acc_as_wrong"))


def delta(verdicts: DataFrame, subset: str) -> DataFrame:
    """``acc_full``, ``acc_subset`` and full minus subset per model; models without a subset verdict are left out."""
    s = F.col(subset).cast("bigint")
    out = verdicts.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum(s).alias("n_subset"), (F.sum("is_correct") / F.count(F.lit(1))).alias("acc_full"),
        F.try_divide(F.sum(F.col("is_correct") * s), F.sum(s)).alias("acc_subset"),
    ).where("n_subset > 0")
    return out.withColumn("delta", F.col("acc_full") - F.col("acc_subset"))


def by_format(verdicts: DataFrame, problems: DataFrame) -> DataFrame:
    """Accuracy in percent on choices, blanks and full equations; verdicts on unknown problems are left out."""
    kind = F.when(F.col("type") == "MCQ", "mcq").when(F.col("type") == "fill_blank_100", "fec").otherwise("fill")
    v = verdicts.join(problems.select("problem_id", kind.alias("kind")), "problem_id")
    acc = lambda k: F.try_divide(100 * F.sum(F.when(F.col("kind") == k, F.col("is_correct"))), F.count(F.when(F.col("kind") == k, 1))).alias(f"acc_{k}")
    return v.groupBy("model").agg(*[acc(k) for k in ("mcq", "fill", "fec")])


def subset_gain(verdicts: DataFrame, ids: DataFrame) -> DataFrame:
    """Accuracy in percent on ``ids`` and on all, and subset minus full."""
    v = verdicts.join(ids.select("problem_id").distinct().withColumn("inside", F.lit(1)), "problem_id", "left")
    full = 100 * F.sum("is_correct") / F.count(F.lit(1))
    part = F.try_divide(100 * F.sum(F.col("is_correct") * F.col("inside")), F.sum("inside"))
    return v.groupBy("model").agg(F.count("inside").alias("n_subset"), full.alias("acc_full"), part.alias("acc_subset"), (part - full).alias("delta_pp"))


def disjoint_vs_rest(verdicts: DataFrame, ids: DataFrame) -> DataFrame:
    """Per model and over all (``model`` = '*'): counts and accuracy on ``ids`` and on the rest; a side without verdicts has none."""
    v = verdicts.join(ids.select("problem_id").distinct().withColumn("inside", F.lit(1)), "problem_id", "left")
    rest = F.col("inside").isNull()
    cols = [
        F.count("inside").alias("n_disjoint"), F.coalesce(F.sum(F.when(~rest, F.col("is_correct"))), F.lit(0)).alias("correct_disjoint"),
        F.count(F.when(rest, 1)).alias("n_rest"), F.coalesce(F.sum(F.when(rest, F.col("is_correct"))), F.lit(0)).alias("correct_rest"),
    ]
    both = v.rollup("model").agg(F.grouping("model").alias("all"), *cols).select(F.when(F.col("all") == 1, "*").otherwise(F.col("model")).alias("model"), "n_disjoint", "correct_disjoint", "n_rest", "correct_rest")
    a, b = F.try_divide("correct_disjoint", "n_disjoint"), F.try_divide("correct_rest", "n_rest")
    return both.withColumns({"acc_disjoint": a, "acc_rest": b, "delta": a - b})


def by_bucket(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("model", bucket("hits_total").alias("bucket")).agg((F.sum("is_correct") / F.count(F.lit(1))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def bucket_matrix(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("model").pivot("b", BUCKETS).agg(F.sum("is_correct") / F.count(F.lit(1))) if "b" in verdicts.columns else bucket_matrix(verdicts.withColumn("b", bucket("hits_total")))


def complete_cases(verdicts: DataFrame) -> DataFrame:
    """The verdicts on problems that every model has one on, in long form."""
    models = verdicts.agg(F.countDistinct("model").alias("k"))
    full = verdicts.groupBy("problem_id").agg(F.countDistinct("model").alias("have")).join(F.broadcast(models), F.col("have") == F.col("k")).select("problem_id")
    return verdicts.join(full, "problem_id", "left_semi")


def budget_gain(small: DataFrame, large: DataFrame) -> DataFrame:
    """Accuracy in percent at two budgets, and the gain; blank where a model has no twin."""
    acc = lambda v, name: v.groupBy("model").agg((100 * F.sum("is_correct") / F.count(F.lit(1))).alias(name))
    return acc(large, "acc_large").join(acc(small, "acc_small"), "model", "left").withColumn("gain_pp", F.col("acc_large") - F.col("acc_small"))


def acc_by_n(verdicts: DataFrame, membership: DataFrame) -> DataFrame:
    """Accuracy on the clean set of each n; ids of ``membership`` that have no verdict are ignored."""
    v = verdicts.select("model", "problem_id", "is_correct").join(membership.select("problem_id", "n", "in_s0"), "problem_id")
    s = F.col("in_s0").cast("bigint")
    full = F.sum("is_correct") / F.count(F.lit(1))
    part = F.try_divide(F.sum(F.col("is_correct") * s), F.sum(s))
    return v.groupBy("n", "model").agg(F.sum(s).alias("n_s0"), full.alias("acc_full"), part.alias("acc_s0"), (full - part).alias("delta"))


def flagged_bound(verdicts: DataFrame) -> DataFrame:
    """How far accuracy could move if every flagged item were answered rightly, in percentage points."""
    s = F.col("in_s0").cast("bigint")
    n, ns = F.count(F.lit(1)), F.sum(s)
    acc = F.try_divide(100 * F.sum(F.col("is_correct") * s), ns)
    return verdicts.groupBy("model").agg((n - ns).alias("n_flagged"), acc.alias("acc_s0"), ((n - ns) * (100 - acc) / n).alias("bound_pp"))


def sign_flips(verdicts: DataFrame) -> DataFrame:
    """Ordered model pairs with their gap on all and on clean items, and whether the sign turns (neither gap zero)."""
    s = F.col("in_s0").cast("bigint")
    acc = verdicts.groupBy("model").agg((F.sum("is_correct") / F.count(F.lit(1))).alias("full"), F.try_divide(F.sum(F.col("is_correct") * s), F.sum(s)).alias("part"))
    a, b = acc.alias("a"), acc.alias("b")  # one row a model
    pairs = F.broadcast(a).join(b, F.col("a.model") < F.col("b.model"))
    full, part = F.col("a.full") - F.col("b.full"), F.col("a.part") - F.col("b.part")
    return pairs.select(F.col("a.model").alias("model_i"), F.col("b.model").alias("model_j"), full.alias("delta_full"), part.alias("delta_s0"), F.coalesce(full * part < 0, F.lit(False)).alias("sign_change"))


def judge_table(rows: DataFrame) -> DataFrame:
    """Judge against exact match per view: a null verdict counts as wrong, as does a missing answer."""
    j, e = F.coalesce(F.col("is_correct").cast("bigint"), F.lit(0)), F.col("exact_ok").cast("bigint")
    n = F.count(F.lit(1))
    return rows.groupBy("model").agg(
        n.alias("n"), F.sum(j).alias("judge_correct"), F.sum(e).alias("exact_correct"), F.sum(j * e).alias("both"), F.sum((1 - j) * e).alias("exact_only"),
        F.format_string("%.2f", F.bround(100 * F.sum(e) / n, 2)).alias("exact_pct"), F.format_string("%+.2f", F.bround(100 * (F.sum(e) - F.sum(j)) / n, 2)).alias("gap_pp"),
    )


def rank_average(df: DataFrame, value: str, out: str, by: list[str]) -> DataFrame:
    """``df`` with ``out``: the rank of ``value`` within ``by``, ties share their mean rank."""
    w = Window.partitionBy(*by)
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0)


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """``n`` and ``rho`` per group; null with fewer than two rows or where a side does not vary."""
    r = rank_average(rank_average(df, x, "_rx", by), y, "_ry", by)
    x_, y_, n = F.col("_rx"), F.col("_ry"), F.count(F.lit(1))  # ranks are halves, so these sums are exact
    vx, vy = n * F.sum(x_ * x_) - F.sum(x_) * F.sum(x_), n * F.sum(y_ * y_) - F.sum(y_) * F.sum(y_)
    rho = F.when((vx > 0) & (vy > 0), (n * F.sum(x_ * y_) - F.sum(x_) * F.sum(y_)) / F.sqrt(vx * vy))
    return r.groupBy(*by).agg(n.alias("n"), rho.alias("rho"))


def run_report(raw: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """``what`` and ``n``: what a run of the comparison works on, and whether it is degraded to clean items.

    ``raw`` has verdicts as loaded (``is_correct`` may be null), ``full`` those
    on all items, if there are any.
    """
    v = raw.where("is_correct is not null")
    clean = v.where("in_s0")
    one = lambda df, what, c: df.agg(F.lit(what).alias("what"), c.cast("bigint").alias("n"))
    n = F.count(F.lit(1))
    problems = F.countDistinct("problem_id")
    parts = [one(raw, "rows", n), one(raw, "dropped_null", F.count_if(F.col("is_correct").isNull())), one(v, "models", F.countDistinct("model")), one(clean, "clean_rows", n), one(complete_cases(clean), "complete_clean_problems", problems)]
    spark = raw.sparkSession
    parts.append(one(complete_cases(full), "complete_problems", problems) if full is not None else spark.createDataFrame([("complete_problems", None)], "what string, n bigint"))
    parts.append(spark.createDataFrame([("degraded", int(full is None))], "what string, n bigint"))
    return reduce(DataFrame.unionByName, parts)
