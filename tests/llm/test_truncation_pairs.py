"""Problems 1 and 5."""

import random

import pytest

pytest.importorskip("benchsieve.llm")

from benchsieve.llm import pairs, truncation
from benchsieve.llm.crf import Crf

WHOLE = [
    None, "", "  \n", "B", "Answer: B", "The final answer is $x+1$.", "Hence we obtain \\boxed{\\frac{a}{b}}", "It holds. Final answer: D", "因此最终结果为\\boxed{B}。", "so the rate is feasible.\n\\end{itemize}\\footnote{a note}",
    "<p>The gain is small.</p>", "```python\nprint(1)\n```", "We are done. The answer is $3$.<ref>lecture 6</ref>", "| 1 | Final answer: C |", "$\\sqrt{x}$", "He said \"stop.\"", "The output was cut by the filter, which reached its limit.",
]
CUT = [
    "The gain is small. Next, bound the correlated", "We may write $\\frac{a}{b", "The sum is \\boxed{x+", "It holds that the rate is\n[connection closed]", "The queue is bou…", "The terahe�", "```python\nprint(1", "Start from $x$ and insert the wideb [output limit reached]",
    "为了限制相干的离散的编码速率，我们令$x$并固定", "<p>The gain is small.</p><p>Here the", "The value of the gain, we may write $x+y$ and", "with 24 dB at the antenna,",
]


@pytest.mark.parametrize("t", WHOLE)
def test_whole(t):
    assert truncation.cut_reason(t) is None


@pytest.mark.parametrize("t", CUT)
def test_cut(t):
    assert truncation.cut_reason(t)


def test_recall_on_made_cuts():
    rng = random.Random(2)
    whole = [f"The {a} link bounds the {b} queue, hence $x_{{{i}}}$ stays above {i} dB. Therefore the result is $\\frac{{{i}}}{{k}}$." for i, (a, b) in enumerate([("slow", "long"), ("wide", "short"), ("noisy", "idle")] * 30)]
    assert not any(map(truncation.cut_reason, whole))
    cut = [w[: rng.randrange(40, len(w) - 30)].rstrip() for w in whole]
    cut = [c for c in cut if c[-1] not in ".!?"]
    assert sum(bool(truncation.cut_reason(c)) for c in cut) >= 0.9 * len(cut)  # one that ends on a whole formula may be complete


def test_mark_and_report(spark):
    rows = [(1, "M", "The gain is", "x"), (2, " m", "The gain is small.", "x"), (3, "m", None, "x"), (4, None, "", "x"), (5, "m", "The gain is", "x"), (6, "m", "x" * 60_000, "x")]
    df = spark.createDataFrame(rows, "response_id bigint, model string, candidate string, rid string")
    got = {r["response_id"]: r["cut_reason"] for r in truncation.mark_truncated(df, "response_id", "candidate").collect()}
    assert {k for k, v in got.items() if v} == {1, 5, 6}
    old = spark.createDataFrame([("M", 5, 3.38)], "model string, n_truncated bigint, trunc_rate double")
    rep = {r["model"]: r for r in truncation.truncation_report(df.drop("rid"), "response_id", "candidate", "model", old).collect()}
    assert rep["m"]["n_total"] == 5 and rep["m"]["n_truncated"] == 3 and rep["m"]["archived_trunc_rate"] == pytest.approx(0.0338)
    assert rep[None]["n_total"] == 1
    assert truncation.mark_truncated(df.limit(0), "response_id", "candidate").count() == 0


def test_prefix_links(spark):
    rng = random.Random(0)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randrange(16, 60))) for _ in range(150)]
    values = base + [b + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for b in base[:60]] + base[:40] + ["common start " * 3 + str(i) for i in range(50)]
    want = {v for v in values if any(w != v and w.startswith(v) for w in values)}
    df = spark.createDataFrame([(v,) for v in values] + [(None,), ("",)], "v string")
    assert {r["value"] for r in truncation.prefix_links(df, "v", 10).collect()} == {v for v in want if len(v) >= 10}
    assert truncation.prefix_links(df.limit(0), "v").count() == 0


Q = "A stale steering vector uses $d_1$ as its step size under a cooperative constraint of 65 MHz. Derive the outage event of the passive relay."
BG = "The proof handles the covariance matrix first and then the superposed pilot sequence."
FOREIGN = "Die langsame Kopplung begrenzt die Leistung, solange der Wert unter 5 dB liegt. Das Ergebnis lautet \\boxed{A}."
CASES = [
    (None, "empty"), ("", "empty"), ("\u200b", "empty"), ("N/A", "empty"), ("\\boxed{}", "empty"), ("Answer:", "empty"), ("(blank)", "empty"),
    ("I'm sorry, but I cannot help with this request. Please consult an engineer.", "refusal"), (Q + " I am unable to solve problems like this.", "refusal"), ("Unfortunately, my policy prevents me from answering.\nFor background: the relay is passive.", "refusal"),
    (Q, "copied"), ("Problem: " + BG + "\n" + Q.lower(), "copied"), (Q.replace("$d_1$", "\\(d_{1}\\)").replace(". ", ".\n"), "copied"),
    (FOREIGN, "language"), ("The gain of the channel is bounded. Next, bound the correl", "truncated"),
    ("B", None), ("$x+1$", None), ("Sorry, the earlier draft misread the gain. Substituting the rate removes it. The final answer is $x+1$.", None), (Q + "\nThe gain is constant. Hence we obtain \\boxed{x}", None),
    ("I cannot be fully certain about the gain, but here is a derivation. Therefore the final answer is (D).", None), ('The note says "die langsame Kopplung begrenzt die Leistung". The rate is then bounded by the gain. The answer is C.', None),
]


def test_defects(spark):
    rows = [(i, "p", c, True, None) for i, (c, _) in enumerate(CASES)] + [(900, "unknown", "The answer is C.", None, None), (901, None, "It is so that the", None, None)]
    resp = spark.createDataFrame(rows, "response_id bigint, problem_id string, candidate string, is_correct boolean, rationale string").withColumn("question", pairs.F.lit("clash"))
    asked = spark.createDataFrame([("p", Q, BG)], "problem_id string, question string, background string")
    got = {r["response_id"]: r["defect"] for r in pairs.mark_pairs(resp, asked).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]
    assert got[900] is None and got[901] == "truncated"
    assert pairs.mark_pairs(resp.limit(0), asked).count() == 0


def test_hot_question_is_not_shuffled_away(spark):
    resp = spark.createDataFrame([(i, "hot" if i % 3 else f"p{i}", "x") for i in range(600)], "response_id bigint, problem_id string, candidate string")
    asked = spark.createDataFrame([("hot", "q", None)] + [(f"p{i}", "r", None) for i in range(300)], "problem_id string, question string, background string")
    got = pairs.with_questions(resp, asked).collect()
    assert len(got) == 600 and sum(r["question"] == "q" for r in got) == 400 and sum(r["question"] is None for r in got) == 100


def test_crf_learns_transitions():
    import numpy as np

    rng = np.random.default_rng(0)
    seqs, tags = [], []
    for _ in range(60):
        t = np.repeat([0, 1], 4)
        x = np.stack([np.ones(8), t + rng.normal(0, 0.8, 8)], 1)
        seqs.append(x)
        tags.append(t)
    crf = Crf(2, 2).fit(seqs[:40], tags[:40])
    hit = np.mean([np.mean(np.array(crf.tag(x)) == t) for x, t in zip(seqs[40:], tags[40:])])
    alone = np.mean([np.mean((x[:, 1] > 0.5) == t) for x, t in zip(seqs[40:], tags[40:])])
    assert hit > alone + 0.05  # neighbours help


def test_viterbi_is_the_best_sequence():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(30):
        crf = Crf(3, 3)
        crf.emit, crf.move, crf.first = rng.normal(size=(3, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        x = rng.normal(size=(5, 3))

        def score(s, crf=crf, x=x):
            return crf.first[s[0]] + sum((x @ crf.emit)[i, k] for i, k in enumerate(s)) + sum(crf.move[a, b] for a, b in zip(s, s[1:]))

        assert score(crf.tag(x)) == pytest.approx(max(map(score, itertools.product(range(3), repeat=5))))


def test_held_out_accuracy_of_the_tagger(spark, sf):
    """Fitted on clauses of some questions and tried on those of others, against the weights it starts from."""
    import numpy as np

    asked = {r["problem_id"]: r for r in pairs.questions_of(spark.read.parquet(f"{sf}/problems_cc_by.parquet"), spark.read.parquet(f"{sf}/external_items.parquet")).collect()}
    rows = spark.read.parquet(f"{sf}/cleaned_jsonl.parquet").where("candidate is not null").select("problem_id", "candidate").collect()
    known = sorted((r["problem_id"], r["candidate"]) for r in rows if r["problem_id"] in asked and asked[r["problem_id"]]["question"])
    ids = sorted({k for k, _ in known})
    held = set(ids[::2])
    made = lambda inside: [(asked[k]["question"], asked[k]["background"], c) for k, c in known if (k in held) == inside]
    fitted, start = pairs.fit_tagger(made(False)), pairs.hand_set()
    seqs, tags = pairs._training(made(True), seed=9)
    right = lambda crf: np.mean([a == b for s, t in zip(seqs, tags) for a, b in zip(crf.tag(s), t)])
    assert sum(map(len, tags)) > 300
    assert right(fitted) >= 0.95 and right(fitted) > right(start) + 0.02


def test_the_field_decides():
    """Without the field's tags of refusal, echo, foreign and unfinished clauses no such defect is found."""
    q = pairs.Question(Q, BG)
    crf = pairs.fit_tagger([(Q.replace("stale", w), BG, f"The {w} gain is constant here. Therefore the result is $y$.") for w in ("slow", "wide", "idle", "noisy", "long")] * 12 + [(Q, BG, FOREIGN)] * 6)
    for text, want in CASES:
        got = pairs.prepared(text, q)
        if got and want:
            assert pairs.by_coverage(got, [pairs.ANSWER] * len(got.parts), q) is None
            assert pairs.defects([(text, q)], crf) == [want], text


def test_bare_answers_are_in_no_language():
    """Whatever the field makes of a clause that says nothing in words."""
    for question in (Q, "Die langsame Kopplung begrenzt die Leistung, solange der Wert unter 5 dB liegt. Bestimmen Sie das Ergebnis."):
        q = pairs.Question(question, None)
        for text in ("A", "\\boxed{x+y}", "$x+y$", "D"):
            got = pairs.prepared(text, q)
            assert pairs.by_coverage(got, [pairs.FOREIGN] * len(got.parts), q) is None


def test_clauses_keep_all_text():
    rng = random.Random(6)
    bits = ["The gain", " is $x.y$", ". ", "\n", "so \\(a. b\\) ", "\n\n", "- ", "很大。", "<p>a</p>", "? ", "\x02", " and\nthen "]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        joined = "".join(c.whole() for c in pairs.clauses(text))
        strip = lambda s: "".join(s.replace("\x02", " ").split())
        assert strip(joined) == strip(text)
        assert all(c.size() == len(c.whole()) for c in pairs.clauses(text))
