"""Readers and sinks on files made here."""

import gzip
import json

import pytest
import zstandard

from benchsieve.sources import corpus, sinks


def test_slices(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one"}\nnot json\n{"text": ""}\n{"raw_content": "two"}\n{"text": "", "content": "three"}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps({"text": "four"}) + "\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/c.jsonl.zst").write_bytes(zstandard.compress(json.dumps({"text": "five"}).encode() + b"\n"))
    (tmp_path / "d.txt").write_text("no")
    df = corpus.read_slices(spark, [f"s:{tmp_path}"])
    assert sorted(r["text"] for r in df.collect()) == ["five", "four", "one", "three", "two"]
    assert df.select("doc_id").distinct().count() == 5 and {r["slice"] for r in df.collect()} == {"s"}


@pytest.mark.parametrize("spec", ["s:org/repo@config", "nocolon", ":x"])
def test_bad_slices_fail(spark, spec):
    with pytest.raises(ValueError):
        corpus.read_slice(spark, spec)


def test_missing_folder_fails(spark):
    with pytest.raises(FileNotFoundError):
        corpus.read_slice(spark, "s:/no/such/folder")


def test_problems_fail_fast(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"problem_id": "1", "text": "x"}\n{"problem_id": "2"}\n')
    with pytest.raises(Exception):
        corpus.read_problems(spark, str(tmp_path / "p.jsonl")).collect()


def test_small_files(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"model": "m", "problem_id": "1", "is_correct": true}\n\n{"model": "m", "problem_id": "2", "is_correct": null}\n')
    assert [tuple(r)[:6] for r in corpus.read_verdicts(spark, str(tmp_path / "v.jsonl")).collect()] == [("m", "1", 1, False, False, 0)]
    (tmp_path / "f.csv").write_text("model,problem_id,is_correct\nm,1,1\nm,2,\n")
    assert corpus.read_optional_verdicts(spark, str(tmp_path / "f.csv")).count() == 1
    assert corpus.read_optional_verdicts(spark, str(tmp_path / "g.csv")) is None
    (tmp_path / "s.csv").write_text("problem_id,in_S0_n8,in_S0_n10,in_S0_n12,in_S0_n13,in_S0_n15\r\n1,False,True,True,True,True\r\n")
    assert [r["in_s0"] for r in corpus.read_membership(spark, str(tmp_path / "s.csv")).orderBy("n").collect()] == [False, True, True, True, True]
    (tmp_path / "ids.json").write_text('["1", "2"]')
    assert corpus.read_ids(spark, str(tmp_path / "ids.json")).count() == 2
    files = spark.createDataFrame([("x/full-16k/a",), ("x/other/a",)], "path string")
    assert [r["view"] for r in corpus.label_views(files, [("16k", "large")]).collect()] == ["large"]


def test_audit_folders_hold_exactly_so_many(spark, tmp_path):
    for n in (8, 13):
        (tmp_path / f"audit-n{n}").mkdir()
        (tmp_path / f"audit-n{n}" / "contamination-audit.jsonl").write_text("".join(json.dumps({"problem_id": str(i), "in_S0": i % 2 == 0}) + "\n" for i in range(6)))
    got = corpus.read_audit_labels(spark, str(tmp_path), 6, (8, 13))
    assert got.count() == 12 and got.where("in_s0").count() == 6
    with pytest.raises(ValueError, match="n 8: 6 rows"):
        corpus.read_audit_labels(spark, str(tmp_path), 7, (8, 13))
    twice = spark.createDataFrame([("m", "1"), ("m", "1"), ("k", "1"), ("k", "2")], "model string, problem_id string")
    with pytest.raises(ValueError, match="model m"):
        corpus.require_counts(twice, "model", "problem_id", 2)


def test_withheld_manifest(spark, tmp_path):
    (tmp_path / "w.csv").write_text("problem_id,paper_id,arxiv_id,split,type,license_class,source_license\n1,b,2,test,MCQ,x,y\n2,a,1, Train,MCQ,x,y\n3,b,2,test,MCQ,x,y\n")
    assert corpus.read_withheld(spark, str(tmp_path / "w.csv")).count() == 3
    assert corpus.read_withheld(spark, str(tmp_path / "w.csv"), "train").count() == 1
    assert [tuple(r) for r in corpus.work_list(corpus.read_withheld(spark, str(tmp_path / "w.csv"))).collect()] == [("a", "1"), ("b", "2")]


def test_file_checks(spark, tmp_path):
    import hashlib

    from benchsieve.operators import release

    (tmp_path / "a.csv").write_text("h\n1\n2\n")
    (tmp_path / "b.csv").write_text("h\n")
    assert {tuple(r) for r in corpus.line_counts(spark, str(tmp_path)).collect()} == {("a.csv", 3), ("b.csv", 1)}
    got = {r["name"]: (r["bytes"], r["sha256"]) for r in release.file_manifest(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["a.csv"] == (6, hashlib.sha256(b"h\n1\n2\n").hexdigest()) and set(got) == {"a.csv", "b.csv"}
    parts = spark.createDataFrame([(2160,), (323,), (2,)], "n int")
    assert release.part_sums(parts, "all", "n", 2485).first()["ok"] and not release.part_sums(parts, "all", "n", 2486).first()["ok"]


def test_staged_tables_are_dropped(spark):
    import os

    from benchsieve import session

    since = session.staged()
    a, b = (session.stage_table(spark.range(5), n) for n in "ab")
    paths = [p.removeprefix("file://") for p in session._staged[since:]]
    assert a.count() == b.count() == 5 and all(map(os.path.isdir, paths))
    session.drop_staged(spark, since, keep=1)
    assert [os.path.isdir(p) for p in paths] == [False, True] and session.staged() == since + 1 and b.count() == 5


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("1", 0, 0, True, True, True), ("2", 3, 9, False, False, False)], "problem_id string, docs_total int, hits_total int, in_s0 boolean, in_s1 boolean, in_s1_hits boolean")
    s = sinks.summary(a)
    assert "problems: 2" in s and "| 3 | 1 |" in s and "warning" in s
    sinks.write_flat_csv(a, str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).where("in_s0 = '1'").count() == 1
    sinks.write_jsonl(a, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert a.select(sinks.fixed("docs_total", 2, True)).collect()[1][0] == "+3.00"
    x = spark.createDataFrame([(89.625,)], "a double").select(sinks.fixed("a", 2)).first()[0]
    assert x == "89.62"
    assert "| 2 |" in sinks.markdown_table(a.select("problem_id"))
    per = spark.createDataFrame([("wiki", 3), ("wiki", 3), ("notes", 1)], "slice string, hits int")
    assert "| wiki | 3 | 2 |" in sinks.summary(a, per_slice=per)
    tex = sinks.tex_table(spark.createDataFrame([("a_b & c", 0.5)], "model string, acc double"), 2)
    assert "a\\_b \\& c & 0.50 \\\\" in tex and tex.startswith("\\begin{tabular}{ll}")
