"""Small cases of the statistics, the answer forms and the greedy split."""

import random

import numpy as np
import pytest

from benchsieve.functions import answers
from benchsieve.functions.ids import author_key, paper_key
from benchsieve.operators import inference, release, verdicts


def p_table(spark, ps):
    return spark.createDataFrame([(i, float(p)) for i, p in enumerate(ps)], "test int, p double")


@pytest.mark.parametrize("ps,want", [([0.01, 0.04, 0.03, 0.5], [True, False, False, False]), ([0.01, 0.049, 0.02, 0.05], [True] * 4)])
def test_bh(spark, ps, want):
    rows = inference.benjamini_hochberg(p_table(spark, ps), "p", ["test"]).orderBy("test").collect()
    assert [r["bh"] for r in rows] == want


def test_holm_and_nesting(spark):
    rows = inference.holm(p_table(spark, [0.01, 0.04, 0.03, 0.5]), "p", ["test"]).orderBy("test").collect()
    assert [r["holm"] for r in rows] == [True, False, False, False]
    rng = random.Random(0)
    t = p_table(spark, [rng.random() ** 4 for _ in range(40)])
    r = inference.holm(inference.benjamini_hochberg(inference.bonferroni(t, "p"), "p", ["test"]), "p", ["test"]).collect()
    assert all((not x["bonferroni"] or x["holm"]) and (not x["holm"] or x["bh"]) for x in r)


def test_two_sided_floor(spark):
    d = spark.createDataFrame([(1.0,)] * 999, "d double")
    assert d.agg(inference.two_sided("d")).first()[0] == 1 / 1000


def test_buckets_ranks_and_spearman(spark):
    b = spark.createDataFrame([(h,) for h in (0, 1, 2, 3, 5, 6, 10, 11, -1)], "h int").select(verdicts.bucket("h")).collect()
    assert [r[0] for r in b] == ["B0", "B1", "B1", "B2", "B2", "B3", "B3", "B4", "B4"]
    v = spark.createDataFrame([("m", 1, 0), ("m", 2, 1), ("m", 2, 1), ("k", 1, 0), ("k", 1, 1)], "model string, x int, y int")
    got = {r["model"]: r["rho"] for r in verdicts.spearman(v, "x", "y", ["model"]).collect()}
    assert got["m"] == pytest.approx(1.0) and got["k"] is None


def test_delta_ci_is_like_numpy(spark):
    rng = random.Random(1)
    rows = [("m", f"{i:04d}", rng.random() < 0.6, rng.random() < 0.5) for i in range(200)]
    v = spark.createDataFrame([(m, p, int(c), s) for m, p, c, s in rows], "model string, problem_id string, is_correct bigint, s boolean")
    a, b = inference.delta_ci(v, "s", 200).first(), inference.numpy_like(v, "s", 2000).first()
    assert abs(a["lo"] - b["lo"]) < 0.03 and abs(a["hi"] - b["hi"]) < 0.03
    x, s = np.array([c for _, _, c, _ in rows], float), np.array([s for *_, s in rows], float)
    at = np.random.default_rng(0).integers(0, 200, size=(2000, 200))
    d = x[at].mean(1) - (x * s)[at].sum(1) / s[at].sum(1)
    assert (b["lo"], b["hi"]) == tuple(np.quantile(d, [0.025, 0.975]))


def test_draws_are_even_and_independent():
    d = inference.draws(0, np.arange(4000), 40)
    n = np.bincount(d.ravel(), minlength=40)
    assert d.min() >= 0 and d.max() == 39 and (((n - 4000) ** 2 / 4000).sum() < 39 + 4 * np.sqrt(78))
    pairs = np.bincount((d[:, 0::2] * 40 + d[:, 1::2]).ravel(), minlength=1600)  # neighbouring slots
    assert ((pairs - 50) ** 2 / 50).sum() < 1599 + 4 * np.sqrt(2 * 1599)
    after = np.bincount((d[:-1, 0] * 40 + d[1:, 0]), minlength=1600)  # neighbouring replicates
    assert ((after - 2.5) ** 2 / 2.5).sum() < 1599 + 5 * np.sqrt(2 * 1599)
    assert (inference.draws(1, np.arange(50), 40) != d[:50]).mean() > 0.9


def test_headline_and_its_degraded_form(spark):
    rng = random.Random(2)
    rows = [(m, f"{i:03d}", int(rng.random() < p), i % 3 > 0) for i in range(150) for m, p in (("a", 0.9), ("b", 0.6), ("c", 0.58))]
    v = spark.createDataFrame(rows, "model string, problem_id string, is_correct bigint, in_s0 boolean")
    full = {r["model_i"]: r for r in inference.headline(v.where("in_s0"), 300, complete=v).collect()}
    assert set(full) == {"b", "c"} and all(r["model_j"] == "a" and r["bonferroni"] and r["p_full"] is not None and r["lo"] <= r["delta"] <= r["hi"] for r in full.values())
    bare = inference.headline(v.where("in_s0"), 300, anchor="b", models=["c", "gone"]).collect()
    assert [(r["model_i"], r["model_j"], r["delta_full"], r["sign_change"]) for r in bare] == [("c", "b", None, False)]


def test_cells_give_what_items_give(spark):
    """Intervals per n from counts of cells, against resampled items."""
    rng = random.Random(4)
    rows = [("m", n, int(rng.random() < 0.7), rng.random() < 0.2 + n / 40) for n in (8, 13) for _ in range(200)]
    v = spark.createDataFrame(rows, "model string, n int, is_correct bigint, in_s0 boolean")
    got = {r["n"]: r for r in inference.by_cells(v, "delta", "in_s0", replicates=4000, per="n").collect()}
    assert set(got) == {8, 13}
    for n, r in got.items():
        x, s = (np.array([float(row[c]) for row in rows if row[1] == n]) for c in (2, 3))
        at = np.random.default_rng(1).integers(0, 200, size=(4000, 200))
        d = x[at].mean(1) - (x * s)[at].sum(1) / s[at].sum(1)
        assert np.abs(np.quantile(d, [0.025, 0.975]) - [r["lo"], r["hi"]]).max() < 0.02 and r["max_abs"] >= max(abs(r["lo"]), abs(r["hi"]))


def test_run_report(spark):
    raw = spark.createDataFrame([("a", "1", True, True), ("b", "1", False, True), ("a", "2", True, False), ("b", "2", None, False)], "model string, problem_id string, is_correct boolean, in_s0 boolean")
    got = {r["what"]: r["n"] for r in verdicts.run_report(raw).collect()}
    assert got == {"rows": 4, "dropped_null": 1, "models": 2, "clean_rows": 2, "complete_clean_problems": 1, "complete_problems": None, "degraded": 1}
    got = {r["what"]: r["n"] for r in verdicts.run_report(raw, raw.where("is_correct is not null")).collect()}
    assert got["complete_problems"] == 1 and got["degraded"] == 0


def test_null_policies_and_scan(spark):
    raw = spark.createDataFrame(
        [("m", "1", True, None, None, None, 1, 1), ("m", "1", False, True, True, 0, 2, 2), ("m", "2", None, None, None, None, 1, 3)],
        "model string, problem_id string, is_correct boolean, in_s0 boolean, in_s1 boolean, hits_total int, judged_at int, response_id int",
    )
    assert verdicts.scan(raw).collect()[0]["is_correct"] == 0 and verdicts.scan(raw, "first").collect()[0]["is_correct"] == 1
    assert verdicts.scan(raw, "all").count() == 2
    r = verdicts.null_policies(raw).first()
    assert (r["n"], r["n_null"], r["acc_dropped"], r["acc_as_wrong"]) == (3, 1, 0.5, 1 / 3)


@pytest.mark.parametrize("t,want", [("\\boxed{\\frac{a}{b}}", ["\\frac{a}{b}"]), ("\\boxed{a", []), ("\\boxed{a} x \\boxed {b}", ["a", "b"]), ("\\boxed{\\boxed{a}}", ["\\boxed{a}"]), (None, [])])
def test_boxed(t, want):
    assert answers.boxed(t) == want


def test_letters_and_exact(spark):
    rows = [
        ("The answer is B. final answer is C", "C", "MCQ", True), ("it is a", "A", "MCQ", False), ("so (D)", "D", "MCQ", True), ("\\boxed{B}", "B", "MCQ", True), (None, "A", "MCQ", False),
        ("x \\boxed{a+b} y \\boxed{c}", "\\boxed{a + b}", "fill", True), ("\\boxed{c}\\boxed{a}", "\\boxed{a}\\boxed{c}", "fill", False), ("we get $\\mathbf{x}=2$", "x=2", "fill", True), ("", "x", "fill", False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, cand string, ans string, kind string, want boolean")
    for r in answers.exact(df, "cand", "ans", "kind").collect():
        assert r["exact_ok"] == r["want"], r


def test_ids(spark):
    rows = [("ARXIV:1509.90089v1", "1509.90089"), (" 1505.90020v1", "1505.90020"), ("1507.90043 (v2)", "1507.90043"), ("none", None), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select(paper_key("a"), "b").collect()
    assert all(x == y for x, y in got)
    rows = [("AU-0000101", "101"), (" AU101", "101"), ("au-101 ", "101"), ("AU-0000000", None), ("tba", None), ("", None), (None, None)]
    assert all(x == y for x, y in spark.createDataFrame(rows, "a string, b string").select(author_key("a"), "b").collect())


def test_greedy_split_overshoots_but_never_tears(spark):
    rows = [(str(i), f"15{i % 3:02d}.9000{i % 3}", "MCQ") for i in range(30)]
    p = spark.createDataFrame(rows, "problem_id string, paper_id string, type string")
    got = release.greedy_split(p, 0.2).collect()
    by = {}
    for r in got:
        by.setdefault(r["paper"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by.values()) and sum(r["split"] == "test" for r in got) == 10
    assert release.greedy_split(p.limit(0)).count() == 0


def test_era_and_months(spark):
    df = spark.createDataFrame([("1804.90001",), ("9912.90001v2",), ("bad",)], "p string")
    assert [r[0] for r in df.select(release.year_month("p")).collect()] == [201804, 199912, None]


def test_whole_bootstrap_is_of_every_model(spark, sf):
    """10,000 replicates on the models of cleaned_jsonl, near numpy's own intervals."""
    from benchsieve.plans import stats_queries as q

    v = q._v(spark, sf).toPandas()
    got = {r["model"]: r for r in q.QUERIES["boot_single_ci_whole"](spark, sf).collect()}
    assert len(got) == v["model"].nunique() > 5
    rng = np.random.default_rng(1)
    for model, g in v.groupby("model"):
        x = g["is_correct"].to_numpy(float)
        lo, hi = np.quantile(100 * x[rng.integers(0, len(x), (10_000, len(x)))].mean(axis=1), [0.025, 0.975])
        step = 100 / len(x) + 1e-6
        assert abs(got[model]["lo"] - lo) <= step and abs(got[model]["hi"] - hi) <= step
    least = [r["replicates"] for r in q.QUERIES["boot_delta_ci_whole"](spark, sf).collect()]
    assert len(least) == len(got) and 9_000 < max(least) <= 10_000


def test_cells_give_what_items_give(spark):
    rng = np.random.default_rng(3)
    x, y, inside = rng.integers(1, 4, 60), rng.integers(0, 2, 60), rng.integers(0, 2, 60)
    v = spark.createDataFrame([("m", str(i), int(a), int(b), int(a == 1), bool(c)) for i, (a, b, c) in enumerate(zip(x, y, inside))], "model string, problem_id string, x int, is_correct int, s int, inside boolean")
    for kind, col, slow in (
        ("single", "s", inference.single_ci(v, 1500)), ("delta", "s", inference.delta_ci(v, "s", 1500)), ("two_sample", "inside", inference.two_sample_ci(v, 1500)), ("spearman", "x", inference.spearman_ci(v, "x", "is_correct", 1500)),
    ):
        a, b = inference.by_cells(v, kind, col).first(), slow.first()
        assert abs(a["lo"] - b["lo"]) < 0.15 * (b["hi"] - b["lo"]) and abs(a["hi"] - b["hi"]) < 0.15 * (b["hi"] - b["lo"])
