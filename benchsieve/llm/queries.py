"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchsieve.functions.ids import paper_key
from benchsieve.llm import chunking, crosssplit, groupsplit, leakage, markup, mixing, packing, pairs, truncation
from benchsieve.session import read, spread, stage_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(read(spark, d, "cleaned_jsonl").select("response_id", "candidate"))
    return truncation.mark_truncated(rows, "response_id", "candidate").where("cut_reason is not null").select("response_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(read(spark, d, "cleaned_jsonl").select("response_id", "candidate", "model"))
    return truncation.truncation_report(rows, "response_id", "candidate", "model", read(spark, d, "truncation_16k"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.held_out_items(read(spark, d, "problems_cc_by"), read(spark, d, "external_items"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    return leakage.find_leaks(docs, _items(spark, d)).select("doc_id", "item_id").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    return leakage.leak_report(_items(spark, d), leakage.find_leaks(docs, _items(spark, d)))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """The two fields of problem 3 with their record keys."""
    answers = read(spark, d, "problems_cc_by").select(F.lit("answer").alias("field_name"), F.col("problem_id").alias("record_key"), F.col("answer").alias("value"))
    candidates = read(spark, d, "cleaned_jsonl").select(F.lit("candidate").alias("field_name"), F.col("response_id").cast("string").alias("record_key"), F.col("candidate").alias("value"))
    return spread(answers).unionByName(spread(candidates))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(_fields(spark, d), ["field_name", "record_key"], "value").where("has_markup").select("field_name", "record_key").distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(_fields(spark, d), ["field_name", "record_key"], "value")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.problem_groups(read(spark, d, "paper_disjoint_split_seed0"), read(spark, d, "problems_cc_by").select("problem_id", "paper_id"), read(spark, d, "source_paper_licenses"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).where("n > 1").select("problem_id", "group_id")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.assign_splits(stage_table(_groups(spark, d), "groups"), read(spark, d, "paper_disjoint_split_seed0").select("problem_id", "type"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    asked = pairs.questions_of(read(spark, d, "problems_cc_by"), read(spark, d, "external_items"))
    return pairs.mark_pairs(spread(read(spark, d, "cleaned_jsonl")), asked)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("defect is not null").select("response_id", "defect")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("defect is not null")


def _problems(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "problems_cc_by").select("problem_id", "paper_id", "split", "question_text", "background"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.cross_split_pairs(_problems(spark, d)).select("problem_id_a", "problem_id_b").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and paper: pairs and leaking problems, also of the archived disjoint view."""
    problems = _problems(spark, d)
    pairs = crosssplit.cross_split_pairs(problems)
    archived = read(spark, d, "paper_disjoint_test").select("problem_id").distinct().withColumn("archived", F.lit(True))
    known = problems.select("problem_id", paper_key("paper_id").alias("paper_key"))
    rows = pairs.join(known, pairs["eval_id"] == known["problem_id"]).drop("problem_id").join(archived, pairs["eval_id"] == archived["problem_id"], "left")
    return rows.groupBy("eval_split", "paper_key").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("eval_id").alias("n_problems"), F.countDistinct(F.when(F.col("archived"), F.col("eval_id"))).alias("n_archived_view")
    )


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text", "source"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_documents(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, d))


def _mixture(spark: SparkSession, d: str, whole: bool = False) -> tuple[DataFrame, list[dict]]:
    """The mixture as its shards have it; with ``whole`` of as many tokens as all documents have, however scarce a source is."""
    counted = mixing.count(_documents(spark, d))
    total = counted.agg(F.sum("n_tokens")).first()[0] if whole else None
    used, plan = mixing.mix(counted, read(spark, d, "mix_targets"), total)
    used = stage_table(used, "uses")
    return mixing.counted_uses(used, mixing.arrange(used)), plan


def p8_uses(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(*_mixture(spark, d))


def p8_large_uses(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d, whole=True)[0]


def p8_large_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(*_mixture(spark, d, whole=True))


def p8_arranged(spark: SparkSession, d: str) -> DataFrame:
    used, _ = mixing.mix(mixing.count(_documents(spark, d)), read(spark, d, "mix_targets"))
    return mixing.arrange(stage_table(used, "uses"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(_documents(spark, d))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_report, p3_found, p3_clean, p4_found, p4_splits, p5_found, p5_pairs, p6_found, p6_report, p7_pack, p7_report, p8_uses, p8_shares, p8_large_uses, p8_large_shares, p8_arranged, p9_pieces)}


_PAPER = "nullif(regexp_extract({}, '(?:^|[^0-9])([0-9]{{4}}[.][0-9]{{4,5}})(?:[^0-9]|$)', 1), '')"
#: Who reaches whom over papers, authors and replacements, by plain recursion.
_GROUPS = f"""own AS (SELECT DISTINCT problem_id, {_PAPER.format('paper_id')} AS paper FROM paper_disjoint_split_seed0 WHERE paper IS NOT NULL),
other AS (SELECT DISTINCT problem_id, {_PAPER.format('paper_id')} AS paper FROM problems_cc_by WHERE paper IS NOT NULL AND problem_id NOT IN (SELECT problem_id FROM own WHERE problem_id IS NOT NULL)),
lic AS (SELECT {_PAPER.format('paper_id')} AS paper, nullif(regexp_extract(lower(trim(author_key)), '^au[-_ ]*0*([1-9][0-9]*)$', 1), '') AS author, {_PAPER.format('replaces_id')} AS replaced FROM source_paper_licenses),
one AS (SELECT 'Q' || problem_id AS a, 'P' || paper AS b FROM own UNION SELECT 'Q' || problem_id, 'P' || paper FROM other UNION SELECT 'P' || paper, 'A' || author FROM lic WHERE paper IS NOT NULL AND author IS NOT NULL UNION SELECT 'P' || paper, 'P' || replaced FROM lic WHERE paper <> replaced),
e AS (SELECT a, b FROM one UNION SELECT b, a FROM one), ids AS (SELECT DISTINCT problem_id FROM paper_disjoint_split_seed0 WHERE problem_id IS NOT NULL),
r AS (SELECT problem_id, 'Q' || problem_id AS node FROM ids UNION SELECT problem_id, b FROM r JOIN e ON a = node),
groups AS (SELECT r.problem_id, min(m.problem_id) AS group_id, count(*) AS n FROM r JOIN ids m ON r.node = 'Q' || m.problem_id GROUP BY 1)"""
SQL = {"p4_found": f"WITH RECURSIVE {_GROUPS} SELECT problem_id, group_id FROM groups WHERE n > 1"}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
