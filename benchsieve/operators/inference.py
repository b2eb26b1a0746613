"""Bootstrap and multiple testing.

Replicates are dealt to tasks, which draw many at once with numpy. ``draws``
come from whole-number arithmetic on (seed, replicate, slot), so that SQL can
repeat them; ``by_cells`` draws how many items fall into each cell instead, for
any number of items; ``numpy_like`` replays numpy's generator for results that
were made with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.05


PRIME = 2**31 - 1
#: Multiplier and addend of each round; every product stays under 2**62.
ROUNDS = ((48271, 11), (69621, 1009), (1583458089, 71))
#: Replicates that a task draws for one unit.
CHUNK = 500


def draws(seed: int, b: np.ndarray, n: int) -> np.ndarray:
    """Item drawn for each replicate ``b`` (rows) and slot (columns) among ``n`` items; the same in SQL."""
    x = ((seed * 7919 + b.astype(np.int64)[:, None]) * 1000003 + np.arange(n)) % PRIME
    for times, plus in ROUNDS:
        x = (x * times + plus) % PRIME
        x ^= x >> 15
    return (x * n) >> 31


def draws_sql(seed: int, source: str, replicates: int) -> str:
    """``source`` with ``b`` and ``drawn``, the slot, for each replicate; it has columns ``slot`` and ``n``."""
    q = f"SELECT *, (({seed} * 7919 + b) * 1000003 + slot) % {PRIME} AS x FROM {source}, range({replicates}) t(b)"
    for times, plus in ROUNDS:
        q = f"SELECT * REPLACE (xor(x, x >> 15) AS x) FROM (SELECT * REPLACE ((x * {times} + {plus}) % {PRIME} AS x) FROM ({q}))"
    return f"(SELECT * EXCLUDE (x), (x * n) >> 31 AS drawn FROM ({q}))"


def replicated(units: DataFrame, replicates: int, schema: str, statistic: Callable[[np.ndarray, tuple], pd.DataFrame]) -> DataFrame:
    """What ``statistic`` gives for blocks of replicates of each row of ``units``, which holds the items of a unit as arrays.

    Items are the problems of one benchmark, so a unit is bounded; replicates
    are spread over tasks, and within one over blocks of bounded memory.
    """
    spark = units.sparkSession
    chunks = -(-replicates // CHUNK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                at, end = row.chunk * CHUNK, min(replicates, (row.chunk + 1) * CHUNK)
                step = max(1, 2_000_000 // max(1, max((len(x) for x in row if isinstance(x, np.ndarray)), default=1)))
                for lo in range(at, end, step):
                    yield statistic(np.arange(lo, min(end, lo + step)), row)

    dealt = units.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return dealt.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, schema)


def units_of(verdicts: DataFrame, columns: dict[str, Column], by: list[str] = ["model"], key: str = "problem_id") -> DataFrame:  # noqa: B006
    """One row per ``by`` with an array for each of ``columns``, items in the order of ``key``; the order is part of the method."""
    got = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), *[c.cast("double").alias(n) for n, c in columns.items()])))
    rows = verdicts.groupBy(*by).agg(got.alias("items"))
    return rows.select(*by, *[F.col("items")[n].alias(n) for n in columns])


def interval(x: str | Column) -> list[Column]:
    """2.5 and 97.5 percent quantiles, interpolated, rounded to nine places."""
    q = F.percentile(x, F.array(F.lit(ALPHA / 2), F.lit(1 - ALPHA / 2)))
    return [F.bround(q[0], 9).alias("lo"), F.bround(q[1], 9).alias("hi")]


def two_sided(x: str | Column) -> Column:
    """Twice the smaller tail at zero, at least 1/(B+1), at most 1."""
    x = F.col(x) if isinstance(x, str) else x
    n = F.count(x)
    tail = F.least(F.count(F.when(x <= 0, 1)), F.count(F.when(x >= 0, 1)))
    return F.least(F.lit(1.0), F.greatest(2 * tail / n, 1 / (n + 1)))


def delta_ci(verdicts: DataFrame, subset: str, replicates: int, seed: int = 0) -> DataFrame:
    """Interval of full minus subset accuracy: items are resampled, and the subset's size varies with them."""

    def one(b: np.ndarray, u: tuple) -> pd.DataFrame:
        at = draws(seed, b, len(u.c))
        ns = u.s[at].sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = u.c[at].sum(1) / len(u.c) - (u.c * u.s)[at].sum(1) / ns
        return pd.DataFrame({"model": u.model, "d": d[ns > 0]})

    rep = replicated(units_of(verdicts, {"c": F.col("is_correct"), "s": F.col(subset).cast("int")}), replicates, "model string, d double", one)
    return rep.groupBy("model").agg(F.count(F.lit(1)).alias("replicates"), *interval("d"), F.bround(F.max(F.abs("d")), 9).alias("max_abs"))


def single_ci(verdicts: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """Interval of accuracy in percent per model."""

    def one(b: np.ndarray, u: tuple) -> pd.DataFrame:
        return pd.DataFrame({"model": u.model, "d": 100 * u.c[draws(seed, b, len(u.c))].sum(1) / len(u.c)})

    return replicated(units_of(verdicts, {"c": F.col("is_correct")}), replicates, "model string, d double", one).groupBy("model").agg(*interval("d"))


def two_sample_ci(verdicts: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """Interval of the gap between items ``inside`` and the rest, which are resampled apart; models with an empty side are left out."""

    def one(b: np.ndarray, u: tuple) -> pd.DataFrame:
        side = [u.c[u.i == x] for x in (1, 0)]
        if not all(map(len, side)):
            return pd.DataFrame({"model": [], "d": []})
        a, r = (x[draws(seed, b, len(x))].sum(1) / len(x) for x in side)
        return pd.DataFrame({"model": u.model, "d": a - r})

    units = units_of(verdicts, {"c": F.col("is_correct"), "i": F.col("inside").cast("int")})
    return replicated(units, replicates, "model string, d double", one).groupBy("model").agg(*interval("d"))


def replicate_accuracy(complete: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """``b``, ``model``, ``acc``: every replicate draws the same items for all models.

    The verdicts of all models on complete cases are one unit, problems times models.
    """
    rows = units_of(complete, {"c": F.col("is_correct")}).groupBy().agg(F.array_sort(F.collect_list(F.struct("model", "c"))).alias("m")).where("size(m) > 0")
    unit = rows.select(F.col("m.model").alias("models"), F.flatten("m.c").alias("c"))

    def one(b: np.ndarray, u: tuple) -> pd.DataFrame:
        c = u.c.reshape(len(u.models), -1)
        at = draws(seed, b, c.shape[1])
        acc = np.stack([x[at].sum(1) for x in c], 1) / c.shape[1]
        return pd.DataFrame({"b": np.repeat(b, len(u.models)), "model": np.tile(u.models, len(b)), "acc": acc.ravel()})

    return replicated(unit, replicates, "b bigint, model string, acc double", one)


def pair_table(complete: DataFrame, replicates: int, seed: int = 0, anchor: DataFrame | None = None) -> DataFrame:
    """Gap, interval and p of each model pair in order of name, or of each model against that in ``anchor`` (one row, ``model``)."""
    acc = complete.groupBy("model").agg((F.sum("is_correct") / F.count(F.lit(1))).alias("acc"))
    boot = replicate_accuracy(complete, replicates, seed)

    def right(df: DataFrame) -> DataFrame:
        return df if anchor is None else df.join(F.broadcast(anchor), "model", "left_semi")

    cond = (F.col("i.model") < F.col("j.model")) if anchor is None else (F.col("i.model") != F.col("j.model"))
    pair = [F.col("i.model").alias("model_i"), F.col("j.model").alias("model_j")]
    point = F.broadcast(acc.alias("i")).join(right(acc).alias("j"), cond).select(*pair, (F.col("i.acc") - F.col("j.acc")).alias("delta"))
    rep = boot.alias("i").join(right(boot).alias("j"), (F.col("i.b") == F.col("j.b")) & cond).select(*pair, (F.col("i.acc") - F.col("j.acc")).alias("d"))
    return point.join(rep.groupBy("model_i", "model_j").agg(*interval("d"), two_sided("d").alias("p")), ["model_i", "model_j"])


def best_model(complete: DataFrame) -> DataFrame:
    """``model``: the one with most right answers, the first by name on ties."""
    acc = complete.groupBy("model").agg(F.sum("is_correct").alias("c"))
    return acc.orderBy(F.desc("c"), "model").limit(1).select("model")


def headline(complete_s0: DataFrame, replicates: int, seed: int = 0, complete: DataFrame | None = None, anchor: str | None = None, models: list[str] | None = None) -> DataFrame:
    """Each model of ``models`` (all if None; absent ones are passed over) against ``anchor``, by default the best on clean items.

    Gap, interval and p on clean items and, where ``complete`` is given, on all
    items, with whether the sign of the gap changes; without it these are null,
    the degraded mode. Bonferroni counts the rows of the table only.
    """
    spark = complete_s0.sparkSession
    top = best_model(complete_s0) if anchor is None else spark.createDataFrame([(anchor,)], "model string")

    def table(c: DataFrame) -> DataFrame:
        if models is not None:
            c = c.join(F.broadcast(top.unionByName(spark.createDataFrame([(m,) for m in models], "model string")).distinct()), "model", "left_semi")
        return pair_table(c, replicates, seed, top)

    clean = table(complete_s0)
    if complete is None:
        none = F.lit(None).cast("double")
        both = clean.select("*", *[none.alias(f"{x}_full") for x in ("delta", "lo", "hi", "p")])
    else:
        full = table(complete)
        both = clean.join(full.select("model_i", "model_j", *[F.col(x).alias(f"{x}_full") for x in ("delta", "lo", "hi", "p")]), ["model_i", "model_j"], "left")
    return bonferroni(both.withColumn("sign_change", sign_change("delta_full", "delta")), "p")


def pair_matrix(complete: DataFrame, complete_s0: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """The table of all pairs on clean items with the gap on all items, sign changes and false-discovery flags."""
    full = pair_table(complete, replicates, seed).select("model_i", "model_j", F.col("delta").alias("delta_full"), F.col("lo").alias("lo_full"), F.col("hi").alias("hi_full"))
    both = pair_table(complete_s0, replicates, seed).join(full, ["model_i", "model_j"], "left")
    turned = sign_change("delta_full", "delta")
    return benjamini_hochberg(both.withColumn("sign_change", turned), "p", ["model_i", "model_j"])


def sign_change(a: str, b: str) -> Column:
    return F.coalesce((F.signum(a) != F.signum(b)) & (F.col(a) != 0) & (F.col(b) != 0), F.lit(False))


def bonferroni(df: DataFrame, p: str, alpha: float = ALPHA) -> DataFrame:
    """Tests are a bounded table: one row a model or pair."""
    return df.withColumn("bonferroni", F.col(p) * F.count(F.lit(1)).over(Window.partitionBy()) <= alpha)


def benjamini_hochberg(df: DataFrame, p: str, ties: list[str], q: float = ALPHA) -> DataFrame:
    """``bh``: rejected are all ranks up to the largest that passes."""
    all_rows = Window.partitionBy()
    r = F.row_number().over(all_rows.orderBy(p, *ties))
    passed = F.max(F.when(F.col(p) <= q * (F.col("_r") / F.col("_m")), F.col("_r"))).over(all_rows)
    return df.withColumn("_r", r).withColumn("_m", F.count(F.lit(1)).over(all_rows)).withColumn("bh", F.coalesce(F.col("_r") <= passed, F.lit(False))).drop("_r", "_m")


def holm(df: DataFrame, p: str, ties: list[str], alpha: float = ALPHA) -> DataFrame:
    """``holm``: step down, and stop at the first that fails."""
    all_rows = Window.partitionBy()
    rows = df.withColumn("_r", F.row_number().over(all_rows.orderBy(p, *ties)) - 1).withColumn("_m", F.count(F.lit(1)).over(all_rows))
    good = F.min(F.when(F.col(p) <= alpha / (F.col("_m") - F.col("_r")), 1).otherwise(0)).over(all_rows.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("holm", good == 1).drop("_r", "_m")


def spearman_ci(df: DataFrame, x: str, y: str, replicates: int, seed: int = 0) -> DataFrame:
    """Interval of the rank correlation per model; replicates in which a side does not vary are dropped.

    Ranks of a resample need the drawn rows themselves: the mean rank of a value
    follows from the counts per value, so only (replicate, value) rows are kept.
    """

    def one(b: np.ndarray, u: tuple) -> pd.DataFrame:
        n = len(u.x)
        at = draws(seed, b, n)
        xs, ys = np.unique(u.x), np.unique(u.y)
        code = np.searchsorted(xs, u.x) * len(ys) + np.searchsorted(ys, u.y)
        drawn = code[at]
        m = np.stack([(drawn == c).sum(1) for c in range(len(xs) * len(ys))], 1).astype(float).reshape(len(b), len(xs), len(ys))
        kx, ky = m.sum(2), m.sum(1)
        rx, ry = np.cumsum(kx, 1) - kx + (kx + 1) / 2, np.cumsum(ky, 1) - ky + (ky + 1) / 2
        sx, sy, xx, yy = (kx * rx).sum(1), (ky * ry).sum(1), (kx * rx * rx).sum(1), (ky * ry * ry).sum(1)
        xy = (m * rx[:, :, None] * ry[:, None, :]).sum((1, 2))
        vx, vy = n * xx - sx**2, n * yy - sy**2
        ok = (vx > 0) & (vy > 0)
        return pd.DataFrame({"model": u.model, "rho": (n * xy - sx * sy)[ok] / np.sqrt((vx * vy)[ok])})

    reps = replicated(units_of(df, {"x": F.col(x), "y": F.col(y)}), replicates, "model string, rho double", one)
    q = F.percentile("rho", F.array(F.lit(ALPHA / 2), F.lit(1 - ALPHA / 2)))
    return reps.groupBy("model").agg(F.count(F.lit(1)).alias("replicates"), F.bround(q[0], 8).alias("lo"), F.bround(q[1], 8).alias("hi"), two_sided("rho").alias("p"))


def numpy_like(verdicts: DataFrame, subset: str, replicates: int, seed: int = 0) -> DataFrame:
    """As ``delta_ci`` with numpy's default generator, started anew for each model; items in the order of ``problem_id``."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("problem_id")
        ic, s = b["is_correct"].to_numpy(float), b["s"].to_numpy(float)
        at = np.random.default_rng(seed).integers(0, len(b), size=(replicates, len(b)))
        ns = s[at].sum(1)
        d = (ic[at].mean(1) - (ic * s)[at].sum(1) / np.where(ns > 0, ns, 1))[ns > 0]
        lo, hi = np.quantile(d, [ALPHA / 2, 1 - ALPHA / 2]) if len(d) else (None, None)
        return pd.DataFrame({"model": [b["model"].iloc[0]], "replicates": [len(d)], "lo": [lo], "hi": [hi]})

    return verdicts.select("model", "problem_id", "is_correct", F.col(subset).alias("s")).groupBy("model").applyInPandas(run, "model string, replicates bigint, lo double, hi double")


def by_cells(verdicts: DataFrame, kind: str, x: str, y: str = "is_correct", replicates: int = 10_000, seed: int = 0, per: str | None = None) -> DataFrame:
    """Intervals of ``delta``, ``single``, ``two_sample`` or ``spearman`` per model, with many replicates.

    ``per`` names a column of whole numbers, for each value of which there is an
    interval of its own, drawn with that number added to the seed.

    These depend only on how many items have each pair of values ``x``, ``y``, and
    resampled items fall into these cells by a multinomial draw (one a side for
    ``two_sample``), so a replicate costs as much as there are cells.
    """

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["x", "y"])
        cx, cy, k = b["x"].to_numpy(float), b["y"].to_numpy(float), b["k"].to_numpy(np.int64)
        rng = np.random.default_rng(seed + (int(b["per"].iloc[0]) if per else 0))
        draw = lambda k: rng.multinomial(k.sum(), k / k.sum(), size=replicates)
        with np.errstate(divide="ignore", invalid="ignore"):
            if kind == "two_sample":
                a, r = cx > 0, cx <= 0
                d = draw(k[a]) @ cy[a] / k[a].sum() - draw(k[r]) @ cy[r] / k[r].sum() if a.any() and r.any() else np.zeros(0)
            else:
                m = draw(k)
                n = k.sum()
                if kind == "single":
                    d = 100 * (m @ cy) / n
                elif kind == "delta":
                    d = (m @ cy) / n - (m @ (cx * cy)) / (m @ cx)
                else:
                    ranks = [sum(m[:, c == v].sum(1)[:, None] * (np.where(c > v, 1.0, 0.0) + np.where(c == v, 0.5, 0.0)) for v in np.unique(c)) + 0.5 for c in (cx, cy)]
                    dx, dy = (r - (n + 1) / 2 for r in ranks)
                    d = (m * dx * dy).sum(1) / np.sqrt((m * dx * dx).sum(1) * (m * dy * dy).sum(1))
        d = d[np.isfinite(d)]
        if not len(d):
            return pd.DataFrame({"model": [b["model"].iloc[0]], "per": [b["per"].iloc[0]], "replicates": [0], "lo": [None], "hi": [None], "max_abs": [None], "p": [None]}).astype({c: float for c in ("lo", "hi", "max_abs", "p")})
        lo, hi = np.quantile(d, [ALPHA / 2, 1 - ALPHA / 2])
        p = min(1.0, max(2 * min((d <= 0).sum(), (d >= 0).sum()) / len(d), 1 / (len(d) + 1)))
        return pd.DataFrame({"model": [b["model"].iloc[0]], "per": [b["per"].iloc[0]], "replicates": [len(d)], "lo": [round(lo, 9)], "hi": [round(hi, 9)], "max_abs": [round(np.abs(d).max(), 9)], "p": [p]})

    which = F.col(per).cast("bigint") if per else F.lit(0).cast("bigint")
    cells = verdicts.groupBy("model", which.alias("per"), F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("k"))
    out = cells.groupBy("model", "per").applyInPandas(run, "model string, per bigint, replicates bigint, lo double, hi double, max_abs double, p double").where("replicates > 0")
    return out.withColumnRenamed("per", per) if per else out.drop("per")
