"""Queries on verdicts, inference, answers and release statistics, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchsieve.functions import answers, text
from benchsieve.functions.ids import paper_key
from benchsieve.operators import audit, inference, release, verdicts
from benchsieve.plans import audit_queries
from benchsieve.session import read, spread

B = 10_000  # replicates of the bootstrap


def _v(spark: SparkSession, d: str, keep: str = "last") -> DataFrame:
    return verdicts.scan(read(spark, d, "cleaned_jsonl").select("model", "problem_id", "is_correct", "in_s0", "in_s1", "hits_total", "judged_at", "response_id"), keep)


_V = """v AS (SELECT model, problem_id, is_correct::BIGINT AS is_correct, coalesce(in_s0, false) AS in_s0, coalesce(in_s1, false) AS in_s1, coalesce(hits_total, 0) AS hits_total FROM (
 SELECT *, row_number() OVER (PARTITION BY model, problem_id ORDER BY judged_at DESC, response_id DESC) AS r FROM cleaned_jsonl WHERE is_correct IS NOT NULL) WHERE r = 1)"""


def _panel(spark: SparkSession, d: str, least: int = 120) -> DataFrame:
    """Every event type's verdicts on every user, a dense table of models and items."""
    u = F.col("user_id")
    hits = F.when(u % 4 == 0, (u * 7) % 15).otherwise(0)
    p = read(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("c"), F.max("value").alias("m"))
    ok = F.when(F.col("c") % 17 == 0, F.lit(None)).when(F.col("m") > least, 1).otherwise(0).cast("bigint")
    p = p.select(F.col("event_type").alias("model"), F.lpad(u.cast("string"), 8, "0").alias("problem_id"), ok.alias("is_correct"), hits.alias("hits_total"), (hits == 0).alias("in_s0"), (hits <= 2).alias("in_s1"), (u % 10 == 3).alias("inside"))
    return p.where("is_correct is not null")


def _panel_sql(name: str = "p", least: int = 120) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT event_type AS model, lpad(user_id::VARCHAR, 8, '0') AS problem_id, (CASE WHEN count(*) % 17 = 0 THEN NULL WHEN max(value) > {least} THEN 1 ELSE 0 END)::BIGINT AS is_correct,
 CASE WHEN user_id % 4 = 0 THEN (user_id * 7) % 15 ELSE 0 END AS hits_total, user_id % 4 <> 0 OR (user_id * 7) % 15 = 0 AS in_s0, user_id % 4 <> 0 OR (user_id * 7) % 15 <= 2 AS in_s1, user_id % 10 = 3 AS inside
 FROM events GROUP BY event_type, user_id) WHERE is_correct IS NOT NULL)"""


_P = _panel_sql()
_BUCKET = "CASE WHEN hits_total = 0 THEN 'B0' WHEN hits_total BETWEEN 1 AND 2 THEN 'B1' WHEN hits_total BETWEEN 3 AND 5 THEN 'B2' WHEN hits_total BETWEEN 6 AND 10 THEN 'B3' ELSE 'B4' END"
_PAPER = "nullif(regexp_extract({c}, '(?:^|[^0-9])([0-9]{{4}}[.][0-9]{{4,5}})(?:[^0-9]|$)', 1), '')"
_YM = f"(SELECT problem_id, type, split, paper_id, {_PAPER.format(c='paper_id')} AS paper FROM problems_cc_by)"


def _public(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "problems_cc_by").where("source_license_class = 'cc_by'").select("problem_id")


def _disjoint(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "paper_disjoint_test").select("problem_id")


def _complete_sql(src: str) -> str:
    return f"(SELECT * FROM {src} WHERE problem_id IN (SELECT problem_id FROM {src} GROUP BY 1 HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM {src})))"


def _boot_sql(src: str, name: str) -> str:
    """CTEs for replicate accuracies of complete cases."""
    return f"""{name}_c AS {_complete_sql(src)}, {name}_i AS (SELECT problem_id, row_number() OVER (ORDER BY problem_id) - 1 AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT problem_id FROM {name}_c)),
{name}_m AS (SELECT b, drawn, any_value(n) AS n, count(*) AS m FROM {inference.draws_sql(0, name + '_i', B)} GROUP BY 1, 2), {name}_v AS (SELECT slot AS drawn, model, is_correct FROM {name}_i JOIN {name}_c USING (problem_id)),
{name} AS (SELECT b, model, sum(m * is_correct)::DOUBLE / max(n) AS acc FROM {name}_m JOIN {name}_v USING (drawn) GROUP BY 1, 2),
{name}_a AS (SELECT model, sum(is_correct)::DOUBLE / count(*) AS acc FROM {name}_c GROUP BY 1)"""


_P2 = "least(1.0, greatest(2 * least(count(*) FILTER (d <= 0), count(*) FILTER (d >= 0))::DOUBLE / count(d), 1.0::DOUBLE / (count(d) + 1)))"
_CI = "round_even(quantile_cont(d, 0.025), 9) AS lo, round_even(quantile_cont(d, 0.975), 9) AS hi"


def _pairs_sql(name: str, cond: str = "i.model < j.model") -> str:
    return f"""(SELECT model_i, model_j, delta, lo, hi, p FROM (SELECT i.model AS model_i, j.model AS model_j, i.acc - j.acc AS delta FROM {name}_a i JOIN {name}_a j ON {cond})
 JOIN (SELECT model_i, model_j, {_CI}, {_P2} AS p FROM (SELECT i.model AS model_i, j.model AS model_j, i.acc - j.acc AS d FROM {name} i JOIN {name} j ON i.b = j.b AND {cond}) GROUP BY 1, 2) USING (model_i, model_j))"""


_TOP = "top AS (SELECT model FROM bs_c GROUP BY 1 ORDER BY sum(is_correct) DESC, model LIMIT 1)"
_VERSUS = "j.model = (SELECT model FROM top) AND i.model <> j.model"


def _slots_sql(src: str, by: str, extra: str) -> str:
    """CTEs for the items with their slots, and how often each replicate drew them."""
    return f"""s AS (SELECT {by}, {extra}, row_number() OVER (PARTITION BY {by} ORDER BY problem_id) - 1 AS slot, count(*) OVER (PARTITION BY {by}) AS n FROM {src}),
m AS (SELECT {by}, b, drawn AS slot, count(*) AS m FROM {inference.draws_sql(0, f'(SELECT {by}, slot, n FROM s)', B)} GROUP BY ALL)"""


def _tests(spark: SparkSession, d: str) -> DataFrame:
    """A table of p-values: one per model, from the table of pairs."""
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("test"), ((F.conv(F.substring(F.md5(F.col("n_name")), 1, 6), 16, 10).cast("bigint") % 1000) * (F.conv(F.substring(F.md5(F.col("n_name")), 7, 6), 16, 10).cast("bigint") % 100) / F.lit(1000000.0)).alias("p"))


_T = "t AS (SELECT n_nationkey AS test, ((('0x' || substr(md5(n_name), 1, 6))::BIGINT % 1000) * (('0x' || substr(md5(n_name), 7, 6))::BIGINT % 100))::DOUBLE / 1000000.0 AS p FROM nation)"


def verdict_scan(s, d):
    return _v(s, d)


def null_policy(s, d):
    return verdicts.null_policies(read(s, d, "cleaned_jsonl"))


def verdict_acc(s, d):
    return _v(s, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("is_correct").alias("n_correct"), (F.sum("is_correct") / F.count(F.lit(1))).alias("acc"))


def acc_by_n(s, d):
    return verdicts.acc_by_n(_v(s, d), audit_queries.n_sweep(s, d))


def pooled_acc(s, d):
    return _v(s, d, "all").agg(F.count(F.lit(1)).alias("n"), F.sum("is_correct").alias("n_correct"), (F.sum("is_correct") / F.count(F.lit(1))).alias("acc"))


def spearman(s, d):
    v = _v(s, d).withColumn("x", F.array_position(F.array(*map(F.lit, verdicts.BUCKETS)), verdicts.bucket("hits_total")).cast("int"))
    return verdicts.spearman(v, "x", "is_correct", ["model"]).withColumn("rho", F.bround("rho", 8))


def spearman_ci(s, d):
    p = _panel(s, d).withColumn("x", F.array_position(F.array(*map(F.lit, verdicts.BUCKETS)), verdicts.bucket("hits_total")).cast("int"))
    return inference.holm(inference.spearman_ci(p, "x", "is_correct", B), "p", ["model"])


def _inside(s, d) -> DataFrame:
    """Verdicts with ``inside``: the problem is of the paper-disjoint test."""
    own = _disjoint(s, d).where("problem_id is not null").distinct().withColumn("inside", F.lit(True))
    return _v(s, d).join(own, "problem_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def spearman_ci_whole(s, d):
    v = _v(s, d).withColumn("x", F.array_position(F.array(*map(F.lit, verdicts.BUCKETS)), verdicts.bucket("hits_total")).cast("int"))
    return inference.holm(inference.by_cells(v, "spearman", "x", replicates=B).drop("max_abs"), "p", ["model"])


def boot_pair_acc(s, d):
    return inference.replicate_accuracy(verdicts.complete_cases(_panel(s, d)), B)


def pair_matrix(s, d):
    p = _panel(s, d)
    return inference.pair_matrix(verdicts.complete_cases(p), verdicts.complete_cases(p.where("in_s0")), B)


def headline_pairs(s, d):
    """Every model against the best on clean items, on clean and on all items."""
    p = _panel(s, d)
    return inference.headline(verdicts.complete_cases(p.where("in_s0")), B, complete=verdicts.complete_cases(p))


def headline_degraded(s, d):
    """The same table where there are no verdicts on other than clean items."""
    return inference.headline(verdicts.complete_cases(_panel(s, d).where("in_s0")), B)


def run_report(s, d):
    """What the comparison of models works on, with verdicts on all items and without."""
    raw = read(s, d, "cleaned_jsonl").select("model", "problem_id", "is_correct", F.coalesce("in_s0", F.lit(False)).alias("in_s0"))
    full = verdicts.run_report(raw, raw.where("is_correct is not null")).withColumn("mode", F.lit("full"))
    return full.unionByName(verdicts.run_report(raw).withColumn("mode", F.lit("degraded")))


def boot_delta_by_n(s, d):
    """Interval and largest gap of full minus clean accuracy for each n of the sweep, with a seed of its own."""
    v = _v(s, d).drop("in_s0").join(audit_queries.n_sweep(s, d).select("problem_id", "n", "in_s0"), "problem_id")
    return inference.by_cells(v, "delta", "in_s0", replicates=B, per="n").drop("p")


def multiple_tests(s, d):
    t = _tests(s, d)
    return inference.holm(inference.benjamini_hochberg(inference.bonferroni(t, "p"), "p", ["test"]), "p", ["test"])


def avg_rank(s, d):
    return verdicts.rank_average(read(s, d, "part").select("p_partkey", "p_brand", "p_size"), "p_size", "rank", ["p_brand"])


def _scored(s, d) -> DataFrame:
    p = read(s, d, "problems_cc_by").where(release.split_key() == "test").select("problem_id", "type", F.when(F.col("type") == "MCQ", F.col("correct_answer")).otherwise(F.coalesce("correct_answer", "answer")).alias("key"))
    v = spread(read(s, d, "cleaned_jsonl").select("response_id", "model", "problem_id", "candidate", "is_correct"))
    return answers.exact(v.join(audit.small(p, 200_000), "problem_id"), "candidate", "key", "type")


def exact_format_rows(s, d):
    return _scored(s, d).select("response_id", "exact_ok")


def exact_format_table(s, d):
    return verdicts.judge_table(_scored(s, d))


def normal_forms(s, d):
    return read(s, d, "problems_cc_by").select("problem_id", answers.normal_form("equation").alias("equation_form"), answers.normal_form("correct_answer").alias("answer_form"))


def mcq_letters(s, d):
    v = answers.with_boxes(spread(read(s, d, "cleaned_jsonl").select("response_id", "candidate")), "candidate", "boxes")
    return v.select("response_id", answers.letter("candidate", "boxes").alias("letter"))


def boxed_parts(s, d):
    v = answers.with_boxes(spread(read(s, d, "cleaned_jsonl").select("response_id", "candidate")), "candidate", "boxes")
    return v.select("response_id", F.size("boxes").alias("n_boxes"), F.array_join("boxes", "\n").alias("boxes"))


def stable_keys(s, d):
    return read(s, d, "problems_cc_by").select("problem_id", F.sha2(F.concat(F.lit("0:"), F.coalesce("paper_id", F.lit("None"))), 256).alias("key"))


def paper_disjoint_view(s, d):
    return release.disjoint_view(read(s, d, "problems_cc_by"))


def view_drift(s, d):
    now = release.disjoint_view(read(s, d, "problems_cc_by")).select("problem_id")
    return release.view_difference(now, read(s, d, "paper_disjoint_test").select("problem_id").distinct())


def month_range(s, d):
    y = read(s, d, "problems_cc_by").select(paper_key("paper_id").alias("paper"), release.year_month("paper_id").alias("ym")).where("paper is not null").distinct()
    return y.agg(F.min("ym").alias("first_month"), F.max("ym").alias("last_month"), F.count(F.lit(1)).alias("n_papers"))


def era_counts(s, d):
    y = read(s, d, "problems_cc_by").select(paper_key("paper_id").alias("paper"), release.year_month("paper_id").alias("ym")).where("paper is not null").distinct()
    total = y.agg(F.count(F.lit(1)).alias("total"))
    per = y.groupBy(release.era("ym").alias("era")).agg(F.count(F.lit(1)).alias("n_papers"))
    return per.join(F.broadcast(total)).select("era", "n_papers", release.pct(F.col("n_papers"), F.col("total")).alias("pct"))


def snapshot_flags(s, d):
    """Flagged share of problems from before and after the corpus was taken, for each n."""
    when = read(s, d, "problems_cc_by").select("problem_id", release.year_month("paper_id").alias("ym")).where("ym is not null")
    f = audit_queries.n_sweep(s, d).join(when, "problem_id")
    post = F.col("ym") >= 202304
    flagged = (~F.col("in_s0")).cast("bigint")
    share = lambda c: F.bround(F.try_divide(100 * F.sum(F.when(c, flagged)), F.count(F.when(c, 1))), 3)
    return f.groupBy("n").agg(share(post).alias("post_flag_pct"), share(~post).alias("pre_flag_pct"))


def overlap_stats(s, d):
    a = read(s, d, "contamination_audit").where("problem_id is not null")
    newest = a.groupBy("problem_id").agg(F.max_by(F.struct("hits_total", "in_s0", "in_s1"), F.struct("audited_at", F.coalesce("hits_total", F.lit(-1)).alias("h"))).alias("v")).select("problem_id", "v.*")
    n = F.count(F.lit(1))
    return newest.agg(n.alias("n"), F.count_if("in_s0").alias("s0"), F.count_if("in_s1").alias("s1"), release.pct(F.count_if("in_s0"), n).alias("s0_pct"), F.count_if(F.col("hits_total") > 0).alias("flagged"), F.max("hits_total").alias("max_hits"), F.median(F.when(F.col("hits_total") > 0, F.col("hits_total"))).alias("median_hits_flagged"))


def overlap_buckets(s, d):
    a = read(s, d, "contamination_audit").where("hits_total is not null")
    h = F.col("hits_total")
    label = F.when(h == 0, "0").when(h <= 2, "1-2").when(h <= 5, "3-5").when(h <= 10, "6-10").otherwise(">=11")
    return a.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def top_flag(s, d):
    """Per suite of external items: items, flagged, mean n-grams and the row with most hits, the first by id on ties."""
    a = audit_queries.audit_external(s, d).join(read(s, d, "external_items").select(F.col("item_id").alias("problem_id"), "suite"), "problem_id")
    order = F.struct("hits_total", F.translate("problem_id", "0123456789", "9876543210"))
    return a.groupBy("suite").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("hits_total") > 0).alias("flagged"), F.bround(F.sum("n_grams_total") / F.count(F.lit(1)), 2).alias("mean_grams"), F.max("hits_total").alias("top_hits"), F.max_by("docs_total", order).alias("top_docs"), F.max_by("problem_id", order).alias("top_item"))


def licence_counts(s, d):
    rows = read(s, d, "problems_cc_by").select("problem_id", paper_key("paper_id").alias("paper"), F.coalesce("source_license_class", F.lit("none")).alias("licence"))
    return rows.groupBy("licence").agg(F.count(F.lit(1)).alias("n_problems"), F.countDistinct("paper").alias("n_papers"), F.count_if(F.col("paper").isNull()).alias("n_without_paper"))


def problems_per_paper(s, d):
    rows = read(s, d, "problems_cc_by").select(paper_key("paper_id").alias("paper")).where("paper is not null").groupBy("paper").agg(F.count(F.lit(1)).alias("k"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n_papers"))


def truncation_rate(s, d):
    rate = F.when(F.col("trunc_rate") > 1, F.col("trunc_rate") / 100).otherwise(F.col("trunc_rate"))
    return read(s, d, "truncation_16k").select("model", "n_total", "n_truncated", F.bround(F.col("n_truncated") / F.col("n_total"), 4).alias("derived_rate"), F.bround(rate, 4).alias("archived_rate"))


def memorization_flags(s, d):
    """Exploratory: flagged problems from before the snapshot which some model answered rightly."""
    a = audit_queries.QUERIES["audit_n13"](s, d).where("not in_s0").select("problem_id", "hits_total")
    when = read(s, d, "problems_cc_by").select("problem_id", release.year_month("paper_id").alias("ym"))
    right = _v(s, d).groupBy("problem_id").agg(F.max("is_correct").alias("right"))
    pre, again = F.coalesce(F.col("ym") < 202304, F.lit(False)), F.coalesce(F.col("right") == 1, F.lit(False))
    return a.join(when, "problem_id").join(right, "problem_id", "left").select("problem_id", "hits_total", pre.alias("pre_snapshot"), again.alias("reproducible"), (pre & again).alias("memorization_signature"))


def id_checks(s, d):
    return release.id_mismatch(read(s, d, "problems_cc_by"), read(s, d, "contamination_audit").where("problem_id is not null"))


def greedy_split(s, d):
    return release.greedy_split(read(s, d, "problems_cc_by").select("problem_id", "paper_id", "type"))


def greedy_relabelled(s, d):
    p = read(s, d, "problems_cc_by").select("problem_id", "paper_id", "type", "split")
    return release.relabelled(p, release.greedy_split(p))


QUERIES = {
    **{f.__name__: f for f in (verdict_scan, null_policy, verdict_acc, acc_by_n, pooled_acc, spearman, spearman_ci, boot_pair_acc, pair_matrix, headline_pairs, headline_degraded, run_report, boot_delta_by_n, multiple_tests, avg_rank, exact_format_rows, exact_format_table, normal_forms, mcq_letters, boxed_parts, stable_keys, paper_disjoint_view, view_drift, month_range, era_counts, snapshot_flags, overlap_stats, overlap_buckets, top_flag, licence_counts, problems_per_paper, truncation_rate, memorization_flags, id_checks, greedy_split, greedy_relabelled)},
    "verdict_delta_s0": lambda s, d: verdicts.delta(_v(s, d), "in_s0"),
    "verdict_delta_s1": lambda s, d: verdicts.delta(_v(s, d), "in_s1"),
    "acc_by_format": lambda s, d: verdicts.by_format(_v(s, d), read(s, d, "problems_cc_by")),
    "acc_public_delta": lambda s, d: verdicts.subset_gain(_v(s, d), _public(s, d)),
    "budget_gain": lambda s, d: verdicts.budget_gain(_panel(s, d, 120), _panel(s, d, 100)),
    "disjoint_vs_rest": lambda s, d: verdicts.disjoint_vs_rest(_v(s, d, "all"), _disjoint(s, d)),
    "bucket_acc": lambda s, d: verdicts.by_bucket(_v(s, d)),
    "bucket_matrix": lambda s, d: verdicts.bucket_matrix(_v(s, d)),
    "complete_case": lambda s, d: verdicts.complete_cases(_panel(s, d)).select("model", "problem_id", "is_correct"),
    "flagged_bound": lambda s, d: verdicts.flagged_bound(_v(s, d)),
    "pair_sign_flips": lambda s, d: verdicts.sign_flips(_v(s, d)),
    "boot_delta_ci": lambda s, d: inference.delta_ci(_panel(s, d), "in_s0", B),
    "boot_single_ci": lambda s, d: inference.single_ci(_panel(s, d), B),
    "boot_two_sample_ci": lambda s, d: inference.two_sample_ci(_panel(s, d), B),
    "boot_delta_ci_whole": lambda s, d: inference.by_cells(_v(s, d), "delta", "in_s0", replicates=B).drop("p"),
    "boot_single_ci_whole": lambda s, d: inference.by_cells(_v(s, d), "single", "in_s0", replicates=B).select("model", "lo", "hi"),
    "boot_two_sample_ci_whole": lambda s, d: inference.by_cells(_inside(s, d), "two_sample", "inside", replicates=B).select("model", "lo", "hi"),
    "spearman_ci_whole": spearman_ci_whole,
    "boot_numpy_like": lambda s, d: inference.numpy_like(_panel(s, d), "in_s0", 1000),
    "split_membership_classes": lambda s, d: release.paper_classes(read(s, d, "problems_cc_by")),
    "type_split_counts": lambda s, d: release.type_split_counts(read(s, d, "problems_cc_by")),
    "target_vector": lambda s, d: release.target_vector(read(s, d, "problems_cc_by")),
}

_SPLIT = "lower(trim(split))"
_NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY audited_at DESC, coalesce(hits_total, -1) DESC) AS r FROM contamination_audit WHERE problem_id IS NOT NULL) WHERE r = 1"
_MONTH = "(SELECT DISTINCT paper, CASE WHEN m BETWEEN 1 AND 12 THEN (CASE WHEN y < 90 THEN 2000 + y ELSE 1900 + y END) * 100 + m END AS ym FROM (SELECT paper, substr(paper, 1, 2)::INT AS y, substr(paper, 3, 2)::INT AS m FROM " + _YM + " WHERE paper IS NOT NULL))"
_WHEN = "(SELECT problem_id, ym FROM " + _YM + " a LEFT JOIN " + _MONTH + " b USING (paper))"
_LISTS = "lists AS (SELECT id, list(box ORDER BY p) AS boxes FROM bx GROUP BY 1)"
_BOXED = "src AS (SELECT response_id AS id, candidate AS txt FROM cleaned_jsonl), " + answers.boxes_sql("src", "bx") + ", " + _LISTS
_SCORED = (
    _BOXED + f""", keys AS (SELECT problem_id AS id, type, CASE WHEN type = 'MCQ' THEN correct_answer ELSE coalesce(correct_answer, answer) END AS txt FROM problems_cc_by WHERE {_SPLIT} = 'test'),
{answers.boxes_sql('keys', 'kx')}, keyed AS (SELECT keys.*, kb FROM keys LEFT JOIN (SELECT id, list(box ORDER BY p) AS kb FROM kx GROUP BY 1) USING (id)),
scored AS (SELECT response_id, model, is_correct, {answers.exact_sql('candidate', 'coalesce(boxes, [])', 'keyed.txt', 'coalesce(kb, [])', 'keyed.type')} AS exact_ok FROM cleaned_jsonl JOIN keyed ON keyed.id = problem_id LEFT JOIN lists ON lists.id = response_id)"""
)
#: The greedy split step by step: of the papers left, that with the least distance by type, then in number, then the least hash.
_GREEDY = f"""g AS (SELECT problem_id, coalesce(paper, 'none') AS paper, coalesce(type, '') AS type FROM {_YM}), ty AS (SELECT type, count(*) AS c, row_number() OVER (ORDER BY type) AS i FROM g GROUP BY 1),
tot AS (SELECT count(*) AS total, round_even(count(*) * 0.2::DOUBLE, 0)::BIGINT AS target, (SELECT list(c ORDER BY i) FROM ty) AS per FROM g),
pap AS (SELECT paper, sha256('0:' || paper) AS key, sum(c)::BIGINT AS size, list(c ORDER BY i) AS cnt FROM (SELECT paper, i, (SELECT count(*) FROM g WHERE g.paper = x.paper AND g.type = ty.type) AS c FROM (SELECT DISTINCT paper FROM g) x, ty) GROUP BY 1),
st AS (SELECT 0 AS step, []::VARCHAR[] AS chosen, list_transform((SELECT per FROM tot), lambda z: 0::BIGINT) AS now, 0::BIGINT AS n UNION ALL
 SELECT step + 1, list_append(chosen, b.paper), list_transform(range(1, len(now) + 1), lambda i: now[i] + b.cnt[i]), n + b.size FROM (
  SELECT step, chosen, now, n, arg_min(struct_pack(paper := paper, cnt := cnt, size := size), printf('%020d%020d', list_sum(list_transform(range(1, len(now) + 1), lambda i: abs((now[i] + cnt[i]) * total - target * per[i])))::BIGINT, abs(n + size - target)) || key) AS b
  FROM st, pap, tot WHERE n < target AND NOT list_contains(chosen, paper) GROUP BY ALL)),
assigned AS (SELECT problem_id, paper, CASE WHEN list_contains((SELECT arg_max(chosen, step) FROM st), paper) THEN 'test' ELSE 'train' END AS split FROM g)"""


def _delta_sql(c: str) -> str:
    return f"WITH {_V} SELECT *, acc_full - acc_subset AS delta FROM (SELECT model, count(*) AS n, sum({c}::INT)::BIGINT AS n_subset, sum(is_correct)::DOUBLE / count(*) AS acc_full, sum(is_correct * {c}::INT)::DOUBLE / nullif(sum({c}::INT), 0) AS acc_subset FROM v GROUP BY 1) WHERE n_subset > 0"


SQL = {
    "verdict_scan": f"WITH {_V} SELECT * FROM v",
    "null_policy": "SELECT model, count(*) AS n, count(*) - count(is_correct) AS n_null, sum(is_correct::INT)::DOUBLE / count(is_correct) AS acc_dropped, coalesce(sum(is_correct::INT), 0)::DOUBLE / count(*) AS acc_as_wrong FROM cleaned_jsonl GROUP BY 1",
    "verdict_acc": f"WITH {_V} SELECT model, count(*) AS n, sum(is_correct)::BIGINT AS n_correct, sum(is_correct)::DOUBLE / count(*) AS acc FROM v GROUP BY 1",
    "acc_by_n": audit_queries._SWEEP_SQL + f", {_V} SELECT n, model, sum(s.in_s0::INT)::BIGINT AS n_s0, sum(is_correct)::DOUBLE / count(*) AS acc_full, sum(is_correct * s.in_s0::INT)::DOUBLE / nullif(sum(s.in_s0::INT), 0) AS acc_s0, sum(is_correct)::DOUBLE / count(*) - sum(is_correct * s.in_s0::INT)::DOUBLE / nullif(sum(s.in_s0::INT), 0) AS delta FROM v JOIN s USING (problem_id) GROUP BY 1, 2",
    "pooled_acc": "SELECT count(*) AS n, sum(is_correct::INT)::BIGINT AS n_correct, sum(is_correct::INT)::DOUBLE / count(*) AS acc FROM cleaned_jsonl WHERE is_correct IS NOT NULL",
    "verdict_delta_s0": _delta_sql("in_s0"),
    "verdict_delta_s1": _delta_sql("in_s1"),
    "acc_by_format": f"WITH {_V}, k AS (SELECT v.*, CASE WHEN type = 'MCQ' THEN 'mcq' WHEN type = 'fill_blank_100' THEN 'fec' ELSE 'fill' END AS k FROM v JOIN problems_cc_by USING (problem_id)) SELECT model, "
    + ", ".join(f"(100 * sum(is_correct) FILTER (k = '{k}'))::DOUBLE / nullif(count(*) FILTER (k = '{k}'), 0) AS acc_{k}" for k in ("mcq", "fill", "fec")) + " FROM k GROUP BY 1",
    "acc_public_delta": f"""WITH {_V}, k AS (SELECT v.*, problem_id IN (SELECT problem_id FROM problems_cc_by WHERE source_license_class = 'cc_by') AS inside FROM v)
SELECT *, acc_subset - acc_full AS delta_pp FROM (SELECT model, count(*) FILTER (inside) AS n_subset, (100 * sum(is_correct))::DOUBLE / count(*) AS acc_full, (100 * sum(is_correct) FILTER (inside))::DOUBLE / nullif(count(*) FILTER (inside), 0) AS acc_subset FROM k GROUP BY 1)""",
    "budget_gain": f"WITH {_panel_sql('a', 120)}, {_panel_sql('b', 100)}, x AS (SELECT model, (100 * sum(is_correct))::DOUBLE / count(*) AS acc_small FROM a GROUP BY 1), y AS (SELECT model, (100 * sum(is_correct))::DOUBLE / count(*) AS acc_large FROM b GROUP BY 1) SELECT model, acc_large, acc_small, acc_large - acc_small AS gain_pp FROM y LEFT JOIN x USING (model)",
    "disjoint_vs_rest": """WITH k AS (SELECT model, is_correct::BIGINT AS c, problem_id IN (SELECT problem_id FROM paper_disjoint_test) AS i FROM cleaned_jsonl WHERE is_correct IS NOT NULL),
g AS (SELECT CASE WHEN grouping(model) = 1 THEN '*' ELSE model END AS model, count(*) FILTER (i) AS n_disjoint, coalesce(sum(c) FILTER (i), 0)::BIGINT AS correct_disjoint, count(*) FILTER (NOT i) AS n_rest, coalesce(sum(c) FILTER (NOT i), 0)::BIGINT AS correct_rest FROM k GROUP BY ROLLUP (model))
SELECT *, correct_disjoint::DOUBLE / nullif(n_disjoint, 0) AS acc_disjoint, correct_rest::DOUBLE / nullif(n_rest, 0) AS acc_rest, correct_disjoint::DOUBLE / nullif(n_disjoint, 0) - correct_rest::DOUBLE / nullif(n_rest, 0) AS delta FROM g""",
    "bucket_acc": f"WITH {_V} SELECT model, {_BUCKET} AS bucket, sum(is_correct)::DOUBLE / count(*) AS accuracy, count(*) AS n FROM v GROUP BY 1, 2",
    "bucket_matrix": f"WITH {_V}, k AS (SELECT *, {_BUCKET} AS bk FROM v) SELECT model, " + ", ".join(f"sum(is_correct) FILTER (bk = '{b}')::DOUBLE / nullif(count(*) FILTER (bk = '{b}'), 0) AS {b}" for b in verdicts.BUCKETS) + " FROM k GROUP BY 1",
    "complete_case": f"WITH {_P} SELECT model, problem_id, is_correct FROM {_complete_sql('p')}",
    "flagged_bound": f"WITH {_V}, g AS (SELECT model, count(*) AS n, sum(in_s0::INT)::BIGINT AS ns, (100 * sum(is_correct * in_s0::INT))::DOUBLE / nullif(sum(in_s0::INT), 0) AS acc_s0 FROM v GROUP BY 1) SELECT model, n - ns AS n_flagged, acc_s0, (n - ns) * (100 - acc_s0) / n AS bound_pp FROM g",
    "pair_sign_flips": f"""WITH {_V}, a AS (SELECT model, sum(is_correct)::DOUBLE / count(*) AS f, sum(is_correct * in_s0::INT)::DOUBLE / nullif(sum(in_s0::INT), 0) AS p FROM v GROUP BY 1)
SELECT x.model AS model_i, y.model AS model_j, x.f - y.f AS delta_full, x.p - y.p AS delta_s0, coalesce((x.f - y.f) * (x.p - y.p) < 0, false) AS sign_change FROM a x JOIN a y ON x.model < y.model""",
    "spearman": f"""WITH {_V}, k AS (SELECT model, list_position(['B0','B1','B2','B3','B4'], {_BUCKET}) AS x, is_correct AS y FROM v),
r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY x) + (count(*) OVER (PARTITION BY model, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY model ORDER BY y) + (count(*) OVER (PARTITION BY model, y) - 1) / 2.0 AS ry FROM k)
SELECT model, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(rx) <> 0 AND stddev_pop(ry) <> 0 THEN round_even(corr(rx, ry), 8) END AS rho FROM r GROUP BY 1""",
    "boot_pair_acc": f"WITH {_P}, {_boot_sql('p', 'bt')} SELECT * FROM bt",
    "pair_matrix": f"""WITH {_P}, q AS (SELECT * FROM p WHERE in_s0), {_boot_sql('p', 'bf')}, {_boot_sql('q', 'bs')},
j AS (SELECT s.*, f.delta AS delta_full, f.lo AS lo_full, f.hi AS hi_full FROM {_pairs_sql('bs')} s LEFT JOIN {_pairs_sql('bf')} f USING (model_i, model_j)),
k AS (SELECT *, row_number() OVER (ORDER BY p, model_i, model_j) AS r, count(*) OVER () AS m FROM j)
SELECT model_i, model_j, delta, lo, hi, p, delta_full, lo_full, hi_full, coalesce(sign(delta_full) <> sign(delta) AND delta_full <> 0 AND delta <> 0, false) AS sign_change,
 coalesce(r <= max(CASE WHEN p <= 0.05::DOUBLE * (r::DOUBLE / m) THEN r END) OVER (), false) AS bh FROM k""",
    "headline_pairs": f"WITH {_P}, q AS (SELECT * FROM p WHERE in_s0), {_boot_sql('q', 'bs')}, {_boot_sql('p', 'bf')}, {_TOP}, f AS (SELECT model_i, model_j, delta AS delta_full, lo AS lo_full, hi AS hi_full, p AS p_full FROM {_pairs_sql('bf', _VERSUS)}) SELECT s.*, delta_full, lo_full, hi_full, p_full, coalesce(sign(delta_full) <> sign(delta) AND delta_full <> 0 AND delta <> 0, false) AS sign_change, p * count(*) OVER () <= 0.05::DOUBLE AS bonferroni FROM {_pairs_sql('bs', _VERSUS)} s LEFT JOIN f USING (model_i, model_j)",
    "headline_degraded": f"WITH {_P}, q AS (SELECT * FROM p WHERE in_s0), {_boot_sql('q', 'bs')}, {_TOP} SELECT *, NULL::DOUBLE AS delta_full, NULL::DOUBLE AS lo_full, NULL::DOUBLE AS hi_full, NULL::DOUBLE AS p_full, false AS sign_change, p * count(*) OVER () <= 0.05::DOUBLE AS bonferroni FROM {_pairs_sql('bs', _VERSUS)}",
    "run_report": f"""WITH r AS (SELECT model, problem_id, is_correct, coalesce(in_s0, false) AS in_s0 FROM cleaned_jsonl), v AS (SELECT * FROM r WHERE is_correct IS NOT NULL), c AS (SELECT * FROM v WHERE in_s0),
x AS (SELECT 'rows' AS what, count(*) AS n FROM r UNION ALL SELECT 'dropped_null', count(*) FILTER (is_correct IS NULL) FROM r UNION ALL SELECT 'models', count(DISTINCT model) FROM v UNION ALL SELECT 'clean_rows', count(*) FROM c
 UNION ALL SELECT 'complete_clean_problems', count(DISTINCT problem_id) FROM {_complete_sql('c')})
SELECT 'full' AS mode, * FROM x UNION ALL SELECT 'degraded', * FROM x UNION ALL SELECT 'full', 'complete_problems', count(DISTINCT problem_id) FROM {_complete_sql('v')} UNION ALL SELECT 'degraded', 'complete_problems', NULL UNION ALL SELECT 'full', 'degraded', 0 UNION ALL SELECT 'degraded', 'degraded', 1""",
    "boot_delta_ci": f"""WITH {_P}, {_slots_sql('p', 'model', 'is_correct, in_s0::INT AS i')},
r AS (SELECT model, b, sum(m * is_correct)::DOUBLE / sum(m) - sum(m * is_correct * i)::DOUBLE / sum(m * i) AS d FROM m JOIN s USING (model, slot) GROUP BY 1, 2 HAVING sum(m * i) > 0)
SELECT model, count(*) AS replicates, {_CI}, round_even(max(abs(d)), 9) AS max_abs FROM r GROUP BY 1""",
    "boot_single_ci": f"WITH {_P}, {_slots_sql('p', 'model', 'is_correct')}, r AS (SELECT model, b, (100 * sum(m * is_correct))::DOUBLE / sum(m) AS d FROM m JOIN s USING (model, slot) GROUP BY 1, 2) SELECT model, {_CI} FROM r GROUP BY 1",
    "boot_two_sample_ci": f"""WITH {_P}, {_slots_sql('p', 'model, inside', 'is_correct')},
r AS (SELECT model, b, sum(m * is_correct) FILTER (inside)::DOUBLE / nullif(sum(m) FILTER (inside), 0) - sum(m * is_correct) FILTER (NOT inside)::DOUBLE / nullif(sum(m) FILTER (NOT inside), 0) AS d FROM m JOIN s USING (model, inside, slot) GROUP BY 1, 2)
SELECT model, {_CI} FROM r WHERE d IS NOT NULL GROUP BY 1""",
    "spearman_ci": f"""WITH {_P}, q AS (SELECT *, list_position(['B0','B1','B2','B3','B4'], {_BUCKET}) AS x FROM p), {_slots_sql('q', 'model', 'is_correct AS y, x')},
c AS (SELECT model, b, x, y, sum(m) AS k FROM m JOIN s USING (model, slot) GROUP BY ALL),
cx AS (SELECT model, b, x, sum(k) OVER (PARTITION BY model, b ORDER BY x) - k + (k + 1) / 2.0 AS rx FROM (SELECT model, b, x, sum(k) AS k FROM c GROUP BY ALL)),
cy AS (SELECT model, b, y, sum(k) OVER (PARTITION BY model, b ORDER BY y) - k + (k + 1) / 2.0 AS ry FROM (SELECT model, b, y, sum(k) AS k FROM c GROUP BY ALL)),
t AS (SELECT model, b, sum(k)::DOUBLE AS n, sum(k * rx)::DOUBLE AS sx, sum(k * ry)::DOUBLE AS sy, sum(k * rx * rx)::DOUBLE AS xx, sum(k * ry * ry)::DOUBLE AS yy, sum(k * rx * ry)::DOUBLE AS xy FROM c JOIN cx USING (model, b, x) JOIN cy USING (model, b, y) GROUP BY 1, 2),
d AS (SELECT model, (n * xy - sx * sy) / sqrt((n * xx - sx * sx) * (n * yy - sy * sy)) AS d FROM t WHERE n * xx - sx * sx > 0 AND n * yy - sy * sy > 0),
g AS (SELECT model, count(*) AS replicates, round_even(quantile_cont(d, 0.025), 8) AS lo, round_even(quantile_cont(d, 0.975), 8) AS hi, {_P2} AS p FROM d GROUP BY 1),
h AS (SELECT *, row_number() OVER (ORDER BY p, model) - 1 AS r, count(*) OVER () AS m FROM g)
SELECT model, replicates, lo, hi, p, min(CASE WHEN p <= 0.05::DOUBLE / (m - r) THEN 1 ELSE 0 END) OVER (ORDER BY r) = 1 AS holm FROM h""",
    "multiple_tests": f"""WITH {_T}, k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS r, count(*) OVER () AS m FROM t)
SELECT test, p, p * m <= 0.05::DOUBLE AS bonferroni, coalesce(r <= max(CASE WHEN p <= 0.05::DOUBLE * (r::DOUBLE / m) THEN r END) OVER (), false) AS bh, min(CASE WHEN p <= 0.05::DOUBLE / (m - r + 1) THEN 1 ELSE 0 END) OVER (ORDER BY r) = 1 AS holm FROM k""",
    "avg_rank": "SELECT p_partkey, p_brand, p_size, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0)::DOUBLE AS rank FROM part",
    "normal_forms": f"SELECT problem_id, {answers.normal_form_sql('equation')} AS equation_form, {answers.normal_form_sql('correct_answer')} AS answer_form FROM problems_cc_by",
    "mcq_letters": f"WITH {_BOXED} SELECT response_id, CASE WHEN candidate IS NULL THEN '' ELSE {answers.letter_sql('candidate', 'coalesce(boxes, [])')} END AS letter FROM cleaned_jsonl LEFT JOIN lists ON id = response_id",
    "boxed_parts": f"WITH {_BOXED} SELECT response_id, coalesce(len(boxes), 0)::INT AS n_boxes, coalesce(array_to_string(boxes, chr(10)), '') AS boxes FROM cleaned_jsonl LEFT JOIN lists ON id = response_id",
    "exact_format_rows": f"WITH {_SCORED} SELECT response_id, exact_ok FROM scored",
    "exact_format_table": f"""WITH {_SCORED}, k AS (SELECT model, coalesce(is_correct::BIGINT, 0) AS j, exact_ok::BIGINT AS e FROM scored)
SELECT model, count(*) AS n, sum(j)::BIGINT AS judge_correct, sum(e)::BIGINT AS exact_correct, sum(j * e)::BIGINT AS both, sum((1 - j) * e)::BIGINT AS exact_only,
 printf('%.2f', round_even(100 * sum(e)::DOUBLE / count(*), 2)) AS exact_pct, printf('%+.2f', round_even(100 * (sum(e) - sum(j))::DOUBLE / count(*), 2)) AS gap_pp FROM k GROUP BY 1""",
    "greedy_split": f"WITH RECURSIVE {_GREEDY} SELECT problem_id, paper, split FROM assigned",
    "greedy_relabelled": f"WITH RECURSIVE {_GREEDY} SELECT p.problem_id, paper_id, p.type, p.split AS original_split, a.split FROM problems_cc_by p JOIN assigned a USING (problem_id)",
    "stable_keys": "SELECT problem_id, sha256(concat('0:', coalesce(paper_id, 'None'))) AS key FROM problems_cc_by",
    "paper_disjoint_view": f"WITH k AS {_YM} SELECT problem_id, paper, type FROM k WHERE {_SPLIT} = 'test' AND paper IS NOT NULL AND paper NOT IN (SELECT paper FROM k WHERE {_SPLIT} = 'train' AND paper IS NOT NULL)",
    "view_drift": f"""WITH k AS {_YM}, a AS (SELECT problem_id FROM k WHERE {_SPLIT} = 'test' AND paper IS NOT NULL AND paper NOT IN (SELECT paper FROM k WHERE {_SPLIT} = 'train' AND paper IS NOT NULL)), b AS (SELECT DISTINCT problem_id FROM paper_disjoint_test)
SELECT problem_id, 'left' AS side FROM a WHERE problem_id NOT IN (SELECT problem_id FROM b) UNION ALL SELECT problem_id, 'right' FROM b WHERE problem_id NOT IN (SELECT problem_id FROM a)""",
    "month_range": f"SELECT min(ym) AS first_month, max(ym) AS last_month, count(*) AS n_papers FROM {_MONTH}",
    "era_counts": f"SELECT CASE WHEN ym // 100 <= 2018 THEN 'to 2018' WHEN ym // 100 <= 2023 THEN '2019 to 2023' WHEN ym IS NOT NULL THEN 'from 2024' END AS era, count(*) AS n_papers, round_even(100 * count(*)::DOUBLE / sum(count(*)) OVER (), 3) AS pct FROM {_MONTH} GROUP BY 1",
    "snapshot_flags": audit_queries._SWEEP_SQL + f", w AS {_WHEN} SELECT n, round_even((100 * sum((NOT in_s0)::INT) FILTER (ym >= 202304))::DOUBLE / nullif(count(*) FILTER (ym >= 202304), 0), 3) AS post_flag_pct, round_even((100 * sum((NOT in_s0)::INT) FILTER (ym < 202304))::DOUBLE / nullif(count(*) FILTER (ym < 202304), 0), 3) AS pre_flag_pct FROM s JOIN w USING (problem_id) WHERE ym IS NOT NULL GROUP BY 1",
    "overlap_stats": f"SELECT count(*) AS n, count(*) FILTER (in_s0) AS s0, count(*) FILTER (in_s1) AS s1, round_even(100 * count(*) FILTER (in_s0)::DOUBLE / count(*), 3) AS s0_pct, count(*) FILTER (hits_total > 0) AS flagged, max(hits_total) AS max_hits, median(hits_total) FILTER (hits_total > 0)::DOUBLE AS median_hits_flagged FROM ({_NEWEST})",
    "overlap_buckets": "SELECT CASE WHEN hits_total = 0 THEN '0' WHEN hits_total <= 2 THEN '1-2' WHEN hits_total <= 5 THEN '3-5' WHEN hits_total <= 10 THEN '6-10' ELSE '>=11' END AS bucket, count(*) AS n FROM contamination_audit WHERE hits_total IS NOT NULL GROUP BY 1",
    "top_flag": "WITH " + audit_queries._audit_sql(13, True, "question_text", "external_items", "item_id") + """, k AS (SELECT audit.*, suite, row_number() OVER (PARTITION BY suite ORDER BY hits_total DESC, problem_id) AS r FROM audit JOIN external_items ON item_id = problem_id)
SELECT suite, count(*) AS items, count(*) FILTER (hits_total > 0) AS flagged, round_even(sum(n_grams_total)::DOUBLE / count(*), 2) AS mean_grams, max(hits_total) AS top_hits, max(docs_total) FILTER (r = 1) AS top_docs, max(problem_id) FILTER (r = 1) AS top_item FROM k GROUP BY 1""",
    "licence_counts": f"SELECT coalesce(source_license_class, 'none') AS licence, count(*) AS n_problems, count(DISTINCT {_PAPER.format(c='paper_id')}) AS n_papers, count(*) FILTER ({_PAPER.format(c='paper_id')} IS NULL) AS n_without_paper FROM problems_cc_by GROUP BY 1",
    "problems_per_paper": f"SELECT k, count(*) AS n_papers FROM (SELECT paper, count(*) AS k FROM {_YM} WHERE paper IS NOT NULL GROUP BY 1) GROUP BY 1",
    "truncation_rate": "SELECT model, n_total, n_truncated, round_even(n_truncated::DOUBLE / n_total, 4) AS derived_rate, round_even(CASE WHEN trunc_rate > 1 THEN trunc_rate / 100 ELSE trunc_rate END, 4) AS archived_rate FROM truncation_16k",
    "memorization_flags": audit_queries._A13 + f""", {_V}, w AS {_WHEN}, rr AS (SELECT problem_id, max(is_correct) AS ok FROM v GROUP BY 1)
SELECT problem_id, hits_total, coalesce(ym < 202304, false) AS pre_snapshot, coalesce(ok = 1, false) AS reproducible, coalesce(ym < 202304, false) AND coalesce(ok = 1, false) AS memorization_signature FROM audit JOIN w USING (problem_id) LEFT JOIN rr USING (problem_id) WHERE NOT in_s0""",
    "id_checks": "WITH a AS (SELECT DISTINCT problem_id AS k FROM problems_cc_by), b AS (SELECT DISTINCT problem_id AS k FROM contamination_audit WHERE problem_id IS NOT NULL) SELECT count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both FROM a FULL JOIN b ON a.k = b.k",
    "split_membership_classes": f"""WITH k AS (SELECT paper, max(({_SPLIT} = 'train')::INT) AS tr, max(({_SPLIT} = 'test')::INT) AS te FROM {_YM} WHERE paper IS NOT NULL GROUP BY 1)
SELECT CASE WHEN tr = 1 AND te = 1 THEN 'both' WHEN tr = 1 THEN 'train only' WHEN te = 1 THEN 'test only' ELSE 'other' END AS class, count(*) AS n_papers FROM k GROUP BY 1""",
    "type_split_counts": f"WITH k AS (SELECT coalesce({_SPLIT}, 'none') AS s, coalesce(type, 'none') AS t FROM problems_cc_by) SELECT CASE WHEN grouping(s) = 1 THEN '*' ELSE s END AS split, CASE WHEN grouping(t) = 1 THEN '*' ELSE t END AS type, count(*) AS n FROM k GROUP BY CUBE (s, t)",
    "target_vector": "SELECT type, count(*) AS n, round_even((SELECT count(*) FROM problems_cc_by) * 0.2::DOUBLE, 0) * count(*) / (SELECT count(*) FROM problems_cc_by)::DOUBLE AS target FROM problems_cc_by GROUP BY 1",
}
