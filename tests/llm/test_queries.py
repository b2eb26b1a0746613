"""Every query of the subpackage on the smallest tables, by what its rows must hold."""

import os

import duckdb
import pytest

pytest.importorskip("benchsieve.llm")

from benchsieve.llm import queries

FOUND = {
    "p1_found": ["response_id"], "p2_found": ["doc_id", "item_id"], "p3_found": ["field_name", "record_key"], "p4_found": ["problem_id", "group_id"], "p5_found": ["response_id", "defect"],
    "p6_found": ["problem_id_a", "problem_id_b"],
}


@pytest.fixture(scope="module")
def run(spark, sf):
    kept = {}

    def get(name):
        if name not in kept:
            df = queries.queries()[name](spark, sf)
            kept[name] = (df.columns, df.collect())
        return kept[name]

    return get


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{sf}/{f}')")
    return c


def one(db, sql):
    return db.execute(sql).fetchone()[0]


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found(run, name):
    cols, rows = run(name)
    assert cols == FOUND[name] and rows and len(set(rows)) == len(rows)


def test_p1(run, db):
    found = {r[0] for r in run("p1_found")[1]}
    rep = run("p1_report")[1]
    assert sum(r["n_total"] for r in rep) == one(db, "select count(*) from cleaned_jsonl") and sum(r["n_truncated"] for r in rep) == len(found)
    assert found <= {r[0] for r in db.execute("select response_id from cleaned_jsonl where trim(candidate) <> ''").fetchall()}


def test_p2(run, db):
    pairs = set(run("p2_found")[1])
    rep = {r["item_id"]: r for r in run("p2_report")[1]}
    assert {r["item_id"] for r in pairs} <= rep.keys()
    for k, r in rep.items():
        assert r["docs_total"] == sum(p["item_id"] == k for p in pairs) and r["in_s0"] == (r["docs_total"] == 0) and r["hits_total"] >= r["docs_total"] >= r["docs_reparameterised"]


def test_p3(run, db):
    clean = run("p3_clean")[1]
    assert len(clean) == one(db, "select (select count(*) from cleaned_jsonl) + (select count(*) from problems_cc_by)")
    assert {(r["field_name"], r["record_key"]) for r in clean if r["has_markup"]} == {tuple(r) for r in run("p3_found")[1]}
    as_it_was = {r[0]: r[1] for r in db.execute("select response_id::varchar, candidate from cleaned_jsonl").fetchall()}
    assert all(r["clean_text"] == as_it_was[r["record_key"]] for r in clean if r["field_name"] == "candidate" and not r["has_markup"])


def test_p4(run, db):
    cur = db.execute(queries.oracle_sql()["p4_found"])
    assert sorted(map(tuple, run("p4_found")[1])) == sorted(cur.fetchall())
    splits = run("p4_splits")[1]
    assert len(splits) == one(db, "select count(distinct problem_id) from paper_disjoint_split_seed0 where problem_id is not null") == len({r["problem_id"] for r in splits})
    by = {}
    for r in splits:
        by.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by.values()) and {r["split"] for r in splits} <= {"train", "validation", "test"}


def test_p5(run):
    found = {tuple(r) for r in run("p5_found")[1]}
    assert {d for _, d in found} == {"empty", "refusal", "copied", "language", "truncated"}
    assert {(r["response_id"], r["defect"]) for r in run("p5_pairs")[1]} == found
    assert {i for i, d in found if d == "truncated"} <= {r[0] for r in run("p1_found")[1]}


def test_p6(run, db):
    split = dict(db.execute("select problem_id, lower(trim(split)) from problems_cc_by").fetchall())
    pairs = run("p6_found")[1]
    for a, b in pairs:
        assert a < b and {split[a], split[b]} in ({"train", "test"}, {"train", "validation"})
    assert sum(r["n_pairs"] for r in run("p6_report")[1]) == len(pairs)


def test_p7(run):
    rows = run("p7_pack")[1]
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["n_tokens"]
    assert max(used.values()) <= 2048
    rep = run("p7_report")[1][0]
    assert rep["n_tokens"] == sum(used.values()) and rep["least_sequences"] <= rep["n_sequences"] == len(used) <= 1.05 * rep["least_sequences"] + 1


def test_p8(run, db):
    most = dict(db.execute("select source_name, max_repeats from mix_targets").fetchall())
    for kind in ("", "large_"):
        uses = run(f"p8_{kind}uses")[1]
        assert len(uses) == one(db, "select count(*) from documents") and all(r["uses"] <= most.get(r["source"], 0) for r in uses)
        rep = run(f"p8_{kind}shares")[1]
        assert sum(r["actual_share"] for r in rep) == pytest.approx(1) and {r["source"] for r in rep} == set(most)
        for r in rep:
            mine = [u for u in uses if u["source"] == r["source"]]
            assert r["tokens_used"] == sum(u["uses"] * u["n_tokens"] for u in mine) and r["tokens_unused"] == sum(u["n_tokens"] for u in mine if not u["uses"])
    assert len(run("p8_arranged")[1]) == sum(r["uses"] for r in run("p8_uses")[1])
    assert sum(r["tokens_used"] for r in run("p8_large_shares")[1]) > sum(r["tokens_used"] for r in run("p8_shares")[1])


def test_p9(run, db):
    rows = run("p9_pieces")[1]
    assert rows and all(0 < r["n_tokens"] <= 512 for r in rows)
    assert {r["doc_id"] for r in rows} <= {r[0] for r in db.execute("select doc_id from documents").fetchall()}
