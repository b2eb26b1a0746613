"""Normalisation, n-grams and the audit against plain Python."""

import random
import re

import pytest

from benchsieve.functions import text
from benchsieve.operators import audit

TEX = re.compile(r"\\[a-zA-Z]+|[\{\}\$]")


def words(s, strip=True):
    s = s or ""
    return (TEX.sub(" ", s.lower()) if strip else s).split()


def brute(problems, docs, n):
    grams = lambda t: [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]
    out = {}
    for pid, t in problems:
        mine = set(grams(words(t)))
        hits = docs_hit = 0
        unique = {}
        for doc, slc, body in docs:
            found = [g for g in grams(words(body)) if g in mine]
            hits += len(found)
            docs_hit += bool(found)
            unique.setdefault(slc, set()).update(found)
        out[pid] = (max(0, len(words(t)) - n + 1), hits, docs_hit, sum(map(len, unique.values())), docs_hit == 0, docs_hit <= 2, hits <= 2)
    return out


@pytest.mark.parametrize("raw,want", [("\\alpha $x$ {Y}", "x y"), ("  A\u00a0b\u2003C\u001cd\u0085e ", "a b c d e"), ("", ""), (None, "")])
def test_normalize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.normalize("t")).first()[0] == want
    assert df.select(text.tokens("t")).first()[0] == want.split()


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "c", "d", "e"]
    body = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    problems = [(f"p{i}", body(rng.randrange(0, 14))) for i in range(12)] + [("empty", ""), ("none", None)]
    docs = [(i, f"s{i % 3}", body(rng.randrange(0, 60))) for i in range(20)] + [(90, "s0", None), (91, "s1", "")]
    p, d = spark.createDataFrame(problems, "problem_id string, text string"), spark.createDataFrame(docs, "doc_id int, slice string, text string")
    for n in (3, 5):
        got = {r[0]: tuple(r[1:]) for r in audit.audit(p, d, n).collect()}
        assert got == brute(problems, docs, n)


def test_audit_small_cases(spark):
    g = "w1 w2 w3"
    p = spark.createDataFrame([("a", g), ("b", g), ("short", "w1 w2")], "problem_id string, text string")
    d = spark.createDataFrame([(1, "s", f"{g} x {g} x {g}"), (2, "s", g)], "doc_id int, slice string, text string")
    got = {r["problem_id"]: r for r in audit.audit(p, d, 3).collect()}
    assert (got["a"]["hits_total"], got["a"]["docs_total"], got["a"]["unique_ngrams_total"]) == (4, 2, 1)
    assert got["b"]["hits_total"] == 4 and not got["a"]["in_s0"] and got["a"]["in_s1"] and not got["a"]["in_s1_hits"]
    assert got["short"]["n_grams_total"] == 0 and got["short"]["in_s0"]
    assert audit.gate(audit.audit(p, d, 3)).first()["below_floor"]
    empty = d.limit(0)
    assert {r["hits_total"] for r in audit.audit(p, empty, 3).collect()} == {0}


def test_duplicate_problem_is_an_error(spark):
    with pytest.raises(ValueError):
        audit.require_unique(spark.createDataFrame([("a",), ("a",)], "problem_id string"))


def test_sweep_is_monotone_and_probe_shuffle_path(spark, sf):
    from benchsieve.plans import audit_queries

    s = audit_queries.n_sweep(spark, sf).groupBy("n").agg({"docs_total": "sum"}).orderBy("n").collect()
    docs = [r[1] for r in s]
    assert docs == sorted(docs, reverse=True)
    p = spark.createDataFrame([("a", "x y z")], "problem_id string, text string")
    d = spark.createDataFrame([(1, "s", "x y z")], "doc_id int, slice string, text string")
    big = audit.small(audit.probe(p, 3), most=0)  # over the bound: no hint
    assert "ResolvedHint" not in big._jdf.queryExecution().analyzed().toString()
    assert audit.corpus_grams(d, 3).join(big, ["g1", "g2"]).count() == 1


def test_stream_equals_batch(spark, sf):
    from benchsieve.plans import audit_queries

    key = ["problem_id", "slice", "hits", "docs"]
    rows = lambda df: sorted(map(tuple, df.select(*key).collect()))
    assert rows(audit_queries.audit_streaming(spark, sf)) == rows(audit_queries.audit_by_source(spark, sf))


def test_bloom_never_misses(spark, sf):
    from benchsieve.plans import audit_queries

    p, d = audit_queries._problems(spark, sf), audit_queries._docs(spark, sf)
    exact = {r["problem_id"]: r["c"] for r in audit.corpus_grams(p.withColumnRenamed("problem_id", "doc_id").withColumn("slice", audit.F.lit("")), 13).join(audit.corpus_grams(d, 13).select("g1", "g2").distinct(), ["g1", "g2"], "left_semi").groupBy("doc_id").agg(audit.F.count("*").alias("c")).withColumnRenamed("doc_id", "problem_id").collect()}
    got = {r["problem_id"]: r for r in audit.bloom_probe(p, d).collect()}
    assert all(got[k]["hits_bloom"] >= v for k, v in exact.items()) and sum(r["hits_bloom"] for r in got.values()) <= sum(exact.values()) * 1.02 + 2
    full = audit.bloom_probe(p, d, items=50).first()
    assert full["fill"] > 0.99


def test_stats_json_and_sums(spark):
    from benchsieve.operators import release
    from benchsieve.sources import sinks

    df = spark.createDataFrame([(2, "a"), (3, "b")], "n int, k string")
    assert sinks.stats_json({"t": df}) == '{"t": [{"k": "a", "n": 2}, {"k": "b", "n": 3}]}'
    assert release.part_sums(df, "t", "n", 5).first()["ok"]


def test_flat_has_every_source(spark, sf):
    from benchsieve.plans import audit_queries as q

    rows = q.audit_flat(spark, sf).collect()
    want = {(r["problem_id"], r["slice"]): (r["hits"], r["docs"], r["unique_ngrams"]) for r in q.audit_by_source(spark, sf).collect()}
    sources = {r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().collect()}
    assert want and {c[len("hits_"):] for c in rows[0].asDict() if c.startswith("hits_")} == sources
    got = {(r["problem_id"], s): tuple(r[f"{c}_{s}"] for c in ("hits", "docs", "unique_ngrams")) for r in rows for s in sources}
    assert {k: v for k, v in got.items() if any(v)} == want


def sweep_texts(spark):
    rng = random.Random(5)
    say = lambda k: " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(k))
    problems = [(f"p{i}", say(30)) for i in range(60)] + [("short", "a1 b2"), ("none", None)]
    docs = [(i, "ab"[i % 2], f"{say(40)} {' '.join(problems[i % 60][1].split()[i % 7 : i % 7 + 6 + i % 12])} {say(20)}") for i in range(120)]
    return problems, docs, spark.createDataFrame(problems, "problem_id string, text string"), spark.createDataFrame(docs, "doc_id int, slice string, text string")


def test_ngrams_are_sifted_not_broadcast(spark, monkeypatch):
    """The driver, which would hold a broadcast, gets no n-grams; the results are those of a brute force."""
    problems, docs, p, d = sweep_texts(spark)
    monkeypatch.setattr(audit, "small", lambda df, *_: pytest.fail("marked for broadcast"))
    by = {n: brute(problems, docs, n) for n in audit.SWEEP}
    got = {(r["problem_id"], r["n"]): r for r in audit.sweep(p, d).collect()}
    assert len(got) == len(problems) * len(audit.SWEEP) and sum(r["hits_total"] for r in got.values()) > 100
    for (k, n), r in got.items():
        assert (r["hits_total"], r["docs_total"], r["in_s0"]) == (by[n][k][1], by[n][k][2], by[n][k][4])
    for r in audit.audit(p, d, 13).collect():
        assert tuple(r)[1:] == by[13][r["problem_id"]]


def test_bitmap_keeps_its_keys_and_few_others(spark):
    keys, others = (spark.range(a, a + 20_000).select(audit.F.xxhash64("id").alias("g1")) for a in (0, 10**6))
    of = audit.bitmap(keys, 20_000)
    assert audit.sift(keys, of).count() == 20_000 and audit.sift(others, of).count() < 20_000 * 0.03
    assert audit.sift(others, audit.bitmap(keys.limit(0), 0)).count() == 0
