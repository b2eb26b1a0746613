"""Problems 7, 8 and 9."""

import os
import random

import numpy as np
import pytest

pytest.importorskip("benchsieve.llm")

from pyspark.sql import functions as F

from benchsieve.llm import chunking, mixing, packing, tokens

if not os.path.exists(tokens.TOKENIZER):
    pytest.skip("no tokenizer file", allow_module_level=True)


def test_pack_shard():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 500):
        sizes = np.minimum(rng.geometric(1 / 400, n), 2048)
        seq, place = packing.pack_shard(sizes)
        used = np.bincount(seq, weights=sizes) if n else np.zeros(0)
        assert (used <= 2048).all() and sorted(zip(seq, place)) == sorted(set(zip(seq, place)))
        if n == 500:
            assert sizes.sum() / (2048 * len(used)) > 0.97
    seq, _ = packing.pack_shard(np.full(10, 1025))  # none fit together
    assert len(set(seq)) == 10


def test_pack(spark):
    texts = [None, "", "one two three", "word " * 5000, "one two three"] + [f"text {i} " * (i % 90) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    rows = packing.pack(df, shard_pieces=64).collect()
    enc, _ = tokens.encoder()
    want = {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t}
    have = {}
    for r in rows:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["n_tokens"]
    assert have == {k: v for k, v in want.items() if v}
    cut = {r["doc_id"] for r in rows if r["piece_no"] > 0}
    assert cut == {k for k, v in want.items() if v > 2048}
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["position"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["n_tokens"]
    assert max(by.values()) <= 2048
    assert packing.fill_report(packing.pack(df)).first()["n_tokens"] == sum(want.values())
    assert packing.pack(df.limit(0)).count() == 0


def mixture(spark, total=None):
    rows = [(i, f"some words {i} " * (1 + i % 7), ["a", "b", "c"][0 if i % 2 else 1 + (i % 10 == 0)]) for i in range(600)] + [(900, "x", None), (901, None, "a"), (902, "y " * 10, "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("uses", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.2, 4), ("gone", 0.1, 3), ("c", 0.2, 4)], "source_name string, target_share double, max_repeats int")
    return docs, *mixing.mix(mixing.count(docs), targets, total)


def test_mix(spark):
    docs, used, plan = mixture(spark)
    rows = used.collect()
    assert len(rows) == docs.count()
    most = {"a": 1, "b": 2, "c": 4}
    assert all(r["uses"] <= most.get(r["source"], 0) for r in rows)
    rep = {r["source"]: r for r in mixing.share_report(used, plan).collect()}
    assert rep["gone"]["status"] == "missing" and rep["gone"]["tokens_used"] == 0
    for s, share in (("a", 5 / 9), ("b", 2 / 9), ("c", 2 / 9)):
        assert rep[s]["actual_share"] == pytest.approx(share, abs=0.01)
    for s in most:
        n = [r["uses"] for r in rows if r["source"] == s]
        assert max(n) - min(n) <= 1
    assert "short" in {r["status"] for r in mixture(spark, 10**7)[2]}


def test_arrange(spark):
    _, used, _ = mixture(spark)
    placed = mixing.arrange(used, shard_tokens=500).collect()
    want = {(r["doc_id"], k) for r in used.collect() for k in range(r["uses"])}
    assert len(placed) == len(want) and {(r["doc_id"], r["copy"]) for r in placed} == want
    by = {}
    for r in placed:
        by.setdefault(r["shard"], []).append(r["position"])
    assert {(r["doc_id"], r["uses"]) for r in mixing.counted_uses(used, mixing.arrange(used, shard_tokens=500)).collect()} == {(r["doc_id"], r["uses"]) for r in used.collect()}
    assert len(by) > 3 and all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert mixing.arrange(used.limit(0)).count() == 0


def test_split_tree(spark):
    for copies, shards in (([100, 30, 7], 8), ([5], 3), ([0, 0, 9], 4), ([10**10, 3], 2)):
        t = list(mixing.leaves(mixing.Node(0, shards, 1, copies, [0] * len(copies)), 0))
        have = np.array([x.have for x in t])
        assert [x.left for x in t] == list(range(shards)) and have.sum(0).tolist() == copies and have.min() >= 0 and have.sum(1).max() - have.sum(1).min() <= 1
        assert (np.array([x.before for x in t]) == np.cumsum(have, 0) - have).all()
    # what the driver leaves to tasks is what it would have made itself
    want = {(s, x.left, x.before[i], x.have[i]) for x in mixing.leaves(mixing.Node(0, 700, 1, [4000, 900], [0, 0]), 0) for i, s in enumerate("ab") if x.have[i]}
    assert {tuple(r) for r in mixing.shard_quotas(spark, ["a", "b"], [4000, 900], 700).collect()} == want


def test_larger_mixture_uses_up_scarce_sources(spark):
    _, used, plan = mixture(spark, 10**7)
    rep = {r["source"]: r for r in mixing.share_report(used, plan).collect()}
    assert all(rep[s]["status"] == "short" and rep[s]["tokens_used"] == rep[s]["tokens"] * rep[s]["max_repeats"] and rep[s]["tokens_unused"] == 0 for s in "abc")


def check(text, limit=64, overlap=8):
    enc, sizes = tokens.encoder()
    n = len(enc.encode_ordinary(text))
    p = chunking.cut(text, enc, sizes, limit, overlap)
    if n <= limit:
        assert p == []
        return p
    at = 0
    for k, (c0, c1, t0, size, over, _) in enumerate(p):
        assert 0 < size <= limit and t0 + over == at and (overlap - 3 <= over <= overlap if k else over == 0)
        at = t0 + size
    assert at == n and p[0][0] == 0 and p[-1][1] == len(text)
    assert text[: p[0][1]] + "".join(text[a[1] : b[1]] for a, b in zip(p, p[1:])) == text
    return p


def test_cut_round_trip():
    rng = random.Random(0)
    bits = ["word ", "Sentence ends here. ", "a, b: c ", "\n", "\n\n", "# Head\n", "长文本没有空格", "é", "x" * 90, "🎉", "$\\frac{a}{b}$ "]
    for _ in range(150):
        check("".join(rng.choice(bits) for _ in range(rng.randrange(1, 200))))
    check("x" * 20_000)
    check("中" * 3000)
    check("🎉" * 400)


def test_cuts_fall_on_strong_boundaries():
    para = "The gain of the channel is bounded by the rate of the queue. " * 2
    p = check("\n\n".join([para.strip()] * 12))
    assert {x[5] for x in p} == {"start", "paragraph"}
    p = check("## One\n\n" + para + "\n\n## Two\n\n" + para + "\n\n## Three\n\n" + para)
    assert [x[5] for x in p].count("heading") >= 1


def test_split_operator(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "word " * 2000), (5, "word " * 2000)], "doc_id bigint, text string").withColumn("piece", F.lit("clash"))
    rows = chunking.split_oversized(df).collect()
    assert {r["doc_id"] for r in rows} == {4, 5} and all(r["n_tokens"] <= 512 for r in rows)
    assert all(r["piece"] == ("word " * 2000)[r["char_start"] : r["char_end"]] for r in rows)
    assert chunking.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunking.split_oversized(df, 100, 60)
