"""Components, group splits and cross-split overlap against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("benchsieve.llm")

from pyspark.sql import functions as F

from benchsieve.llm import components, crosssplit, groupsplit
from benchsieve.llm.prefix import hash_bucket, running_total


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    out = {}
    for x in list(up):
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def found(spark, edges):
    df = components.components(spark.createDataFrame(edges, "a string, b string"))
    out = {}
    for r in df.collect():
        assert r["node"] not in out.get(r["component"], set())
        out.setdefault(r["component"], set()).add(r["node"])
    return sorted(map(sorted, out.values()))


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)]
    edges += [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    assert found(spark, edges + edges[:5] + [("n1", "n1"), (None, "x")]) == union_find(edges)
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_components_level_by_level(spark):
    """The graph of colliding seeds is searched like the first where it is too large for one task."""
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(330)] + [(f"c{i}", f"c{i + 1}") for i in range(200)]
    edges = [(a, b) for a, b in edges if a != b]
    df = components.components(spark.createDataFrame(edges, "a string, b string"), small=0)
    out = {}
    for r in df.collect():
        out.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, out.values())) == union_find(edges)


def test_hubs_are_split(spark):
    edges = [(f"p{i}", "author") for i in range(50)] + [("q", "other")]
    out = components.split_hubs(spark.createDataFrame(edges, "a string, b string"), hub=10)
    assert out.groupBy("b").count().agg(F.max("count")).first()[0] < 30
    got = union_find([(r["a"], r["b"]) for r in out.collect()])
    assert [sorted(x for x in g if x.startswith("p")) for g in got if "p1" in g] == [sorted(f"p{i}" for i in range(50))]


def tables(spark, assigned, problems, licences):
    return (
        spark.createDataFrame(assigned, "problem_id string, paper_id string, type string"),
        spark.createDataFrame(problems, "problem_id string, paper_id string"),
        spark.createDataFrame(licences, "paper_id string, author_key string, replaces_id string"),
    )


def test_problem_groups(spark):
    a, p, lic = tables(
        spark,
        [("1", "1801.90001v1", "x"), ("2", "arXiv:1801.90001", "x"), ("3", None, "x"), ("4", None, "x"), ("5", "1802.90002", "x"), ("6", "1803.90003", "x"), ("7", "1804.90004", None), ("3", "1805.90005", "x"), ("1", "1801.90001v2 ", "x"), ("8", "1806.90006", "x"), ("9", "1807.90007", "x")],
        [("4", "1802.90002V3"), ("3", "1899.90001")],
        [("1803.90003", "AU-007", "1810.90010 v2"), ("1810.90010", None, None), ("1811.90011", "tba", "1810.90010"), ("1811.90011", "AU-8", None), ("1804.90004", " au8", None), ("1806.90006", "AU-0000", None), ("1807.90007", "AU-000", None)],
    )
    got = {r["problem_id"]: (r["group_id"], r["n"]) for r in groupsplit.problem_groups(a, p, lic).collect()}
    assert got == {"1": ("1", 2), "2": ("1", 2), "3": ("3", 1), "4": ("4", 2), "5": ("4", 2), "6": ("6", 2), "7": ("6", 2), "8": ("8", 1), "9": ("9", 1)}
    s = groupsplit.assign_splits(groupsplit.problem_groups(a, p, lic), a.select("problem_id", "type"))
    assert s.count() == 9 and s.groupBy("group_id").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0


def test_empty_groups(spark):
    a, p, lic = tables(spark, [], [], [])
    assert groupsplit.problem_groups(a, p, lic).count() == 0


def test_shares_with_a_giant_group(spark):
    rows = [(str(i), "g0" if i < 900 else f"g{i}", 1) for i in range(3000)]
    g = spark.createDataFrame(rows, "problem_id string, group_id string, n int")
    kinds = spark.createDataFrame([(str(i), "ab"[i % 2]) for i in range(3000)], "problem_id string, type string")
    got = {r["split"]: r["count"] for r in groupsplit.assign_splits(g, kinds).groupBy("split").count().collect()}
    assert abs(got["train"] - 2400) < 60 and abs(got["test"] - 300) < 40 and abs(got["validation"] - 300) < 40


def test_running_total(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    rows = running_total(df, ["g"], ["h"], F.col("id"), "before", hash_bucket("h", 16)).collect()
    for g in range(3):
        run = 0
        for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["h"]):
            assert r["before"] == run
            run += r["id"]


A = "Consider a noisy rate region that serves a linear field sample through a weighted feedback channel with $x_1$ held at 5 km. Find the largest throughput for which the cooperative interval vanishes."
BG = "The proof handles the covariance matrix first, then the superposed pilot sequence."


def test_cross_split(spark):
    other = "A stale steering vector uses $d$ as its step size under a cooperative interference constraint and a limited subcarrier. Derive the outage event of the passive relay."
    swapped = "Find the largest throughput for which the cooperative interval vanishes. Consider a noisy rate regoin that serves a linear field sample through a weighted feedback channel with \\(x_{1}\\) held at 5 km."
    rows = [
        ("1", " Test", A, BG), ("2", "train", A.upper(), None), ("3", "train", swapped, BG), ("4", "train", BG + " " + A, None), ("5", "train", other, BG), ("6", "train", None, None), ("7", "validation", "", None),
        ("8", None, A, BG), ("9", "test", A, BG), ("10", "validation", other, None), ("11", "train", "!", BG), ("12", "test", "word " * 4000, None),
    ]
    p = spark.createDataFrame(rows, "problem_id string, split string, question_text string, background string").withColumn("body", F.lit("clash"))
    got = {(r["problem_id_a"], r["problem_id_b"]) for r in crosssplit.cross_split_pairs(p).collect()}
    want = {tuple(sorted((a, b))) for a in ("1", "9") for b in ("2", "3", "4")} | {tuple(sorted(("10", "5")))}
    assert got == want
    assert crosssplit.cross_split_pairs(p.limit(0)).count() == 0


def keyed(spark, rows):
    return spark.createDataFrame(rows, "key string, body string, context string")


def test_hot_groups_keep_every_pair(spark):
    """Near-copies in numbers beyond what a rare window may have."""
    short = "Derive the smallest covariance margin reached when every passive relay transmits jointly."
    slip = short.replace("smallest", "largest")
    ev = [(f"e{i}", short, f"Background remark number{i} about topic{i}.") for i in range(100)]
    got = {(r["eval_key"], r["train_key"]) for r in crosssplit.near_pairs(keyed(spark, ev), keyed(spark, [("t", short, None), ("u", slip, None)])).collect()}
    assert got == {(f"e{i}", t) for i in range(100) for t in "tu"}
    spread = A
    for i, w in enumerate(("region", "weighted", "largest")):
        spread = spread.replace(w, f"slipped{i}")
    got = crosssplit.near_pairs(keyed(spark, [(f"e{i}", A, f"About topic{i}.") for i in range(100)]), keyed(spark, [("t", spread, None)]))
    assert got.count() == 100


def family(n, seed, words=45):
    """Near-copies of one text: up to a tenth of the words slipped, each in its own places, some in another notation."""
    rng = random.Random(seed)
    base = [f"{a}{b}" for a, b in zip(rng.choices(["noisy", "linear", "weighted", "idle", "coherent", "passive"], k=words), rng.choices(["relay", "queue", "beam", "frame", "margin", "region"], k=words))]
    out = []
    for i in range(n):
        t = list(base)
        for j in rng.sample(range(words), rng.randrange(words // 10)):
            t[j] = f"slip{i}x{j}"
        out.append(" ".join(t).upper() if i % 5 == 0 else " ".join(t))
    return out


@pytest.mark.parametrize("n", [50, 100, 200, 1000])
def test_large_families_keep_every_link(spark, n):
    ev, tr = family(n, 3), family(20, 3)
    got = crosssplit.near_pairs(keyed(spark, [(f"e{i}", t, None) for i, t in enumerate(ev)]), keyed(spark, [(f"t{i}", t, None) for i, t in enumerate(tr)]))
    bags = lambda ts: [set(t.lower().split()) for t in ts]
    e, t = bags(ev), bags(tr)
    want = {(f"e{i}", f"t{j}") for i, a in enumerate(e) for j, b in enumerate(t) if len(a & b) >= 0.8 * max(len(a), len(b))}
    assert len(want) > 15 * n and {(r["eval_key"], r["train_key"]) for r in got.collect()} >= want


def test_partitioned_hashes_give_the_same(spark, monkeypatch):
    """What is too large to broadcast is shuffled; hot hashes in groups."""
    monkeypatch.setattr(crosssplit, "GROUP", 7)
    short = "Derive the smallest covariance margin reached when every passive relay transmits jointly."
    han = "为了限制相干的离散的编码速率，我们令并固定自适应的稀疏的中继链路，求最大的吞吐量。"
    ev = [(f"e{i}", t, None) for i, t in enumerate(family(40, 3))] + [(f"s{i}", short.replace("smallest", f"slip{i}"), f"About topic{i}.") for i in range(20)] + [("h", han, None), ("n", None, "x"), ("b", "", None), ("q", "Find the rate $R$.", A)]
    tr = [(f"t{i}", t, None) for i, t in enumerate(family(20, 3))] + [("s", short, None), ("h2", han.replace("最大", "最小"), BG), ("m", A + " Find the rate $R$.", None), ("o", "Find the rate $R$.", BG), ("n", None, None)]
    rows = lambda **kw: sorted(tuple(r)[:2] for r in crosssplit.near_pairs(keyed(spark, ev), keyed(spark, tr), **kw).collect())
    got = rows(block_chars=0)
    assert got == rows() and {"s", "h2", "m"} <= {r[1] for r in got} and "o" not in {r[1] for r in got}
    assert crosssplit.near_pairs(keyed(spark, []), keyed(spark, tr), block_chars=-1).count() == 0


def test_short_questions(spark):
    ask = "Find the rate $R$."
    ev = [("e", ask, A), ("f", "Find the outage probability floor.", None)]
    tr = [("same", ask, A), ("moved", A + " " + ask, None), ("other", ask, "A stale steering vector uses a step size under a cooperative interference constraint and a limited subcarrier."), ("g", "find the OUTAGE probability floor", None)]
    got = {(r["eval_key"], r["train_key"]) for r in crosssplit.near_pairs(keyed(spark, ev), keyed(spark, tr)).collect()}
    assert got == {("e", "same"), ("e", "moved"), ("f", "g")}


def test_partitioned_pairs_are_not_shuffled(spark, monkeypatch):
    """Records that share windows with very many others: no join, no exchange and no pair on disk, in one file of hashes or in many."""
    monkeypatch.setattr(crosssplit, "GROUP", 50)
    ev = [(f"e{i}", t, None) for i, t in enumerate(family(150, 3) + family(150, 4, 24))] + [("f", "Find the rate $R$.", A)]
    tr = [(f"t{i}", t, BG) for i, t in enumerate(family(120, 3) + family(60, 4, 24))] + [("g", "Find the rate $R$.", A), ("o", BG, A)]
    want = sorted(tuple(r) for r in crosssplit.near_pairs(keyed(spark, ev), keyed(spark, tr)).collect())
    assert len(want) > 20_000
    for chars in (0, 3_000, 70_000):
        got = crosssplit.near_pairs(keyed(spark, ev), keyed(spark, tr), block_chars=chars)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert sorted(tuple(r)[:2] for r in got.collect()) == [r[:2] for r in want]


def test_masks_lose_no_pair():
    rng = np.random.default_rng(4)
    bags = [Counter(rng.integers(0, 1 << 50, 40).tolist() * 2) for _ in range(30)]
    near = [Counter(dict(list(b.items())[: 40 - k % 9])) for k, b in enumerate(bags)]
    (a, n, s), (b, _, u) = (crosssplit._flat([crosssplit._arrays(x) for x in y]) for y in (bags, near))
    lost = np.bitwise_count(crosssplit._masks(a, s) & ~crosssplit._masks(b, u)).sum(axis=0)
    assert (lost <= [k % 9 for k in range(30)]).all() and crosssplit._lack(n, s, 0.8).tolist() == [16] * 30
