"""Queries of the overlap audit and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchsieve.functions import text
from benchsieve.operators import audit
from benchsieve.session import read, shared_dir, spread
from benchsieve.streaming import incremental


def _problems(spark: SparkSession, d: str, col: str = "text") -> DataFrame:
    return spread(read(spark, d, "problems_cc_by").select("problem_id", F.col(col).alias("text")))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", F.col("source").alias("slice"), "text"))


def _audit_sql(n: int, strip: bool = True, col: str = "text", table: str = "problems_cc_by", key: str = "problem_id") -> str:
    return f"""
pt AS (SELECT {key} AS problem_id, {text.tokens_sql(col, strip)} AS toks FROM {table}),
probe AS (SELECT DISTINCT problem_id, g FROM ({text.grams_sql('pt', 'problem_id', n)})),
dt AS (SELECT doc_id, source AS slice, {text.tokens_sql('text', strip)} AS toks FROM documents),
grams AS ({text.grams_sql('dt', 'slice, doc_id', n)}),
hit AS (SELECT problem_id, slice, doc_id, g, count(*) AS c FROM grams JOIN probe USING (g) GROUP BY ALL),
per AS (SELECT problem_id, slice, sum(c)::BIGINT AS hits, count(DISTINCT doc_id) AS docs, count(DISTINCT g) AS unique_ngrams FROM hit GROUP BY ALL),
tot AS (SELECT problem_id, sum(hits) AS h, sum(docs) AS d, sum(unique_ngrams) AS u FROM per GROUP BY ALL),
audit AS (SELECT pt.problem_id, greatest(len(toks) - {n - 1}, 0)::BIGINT AS n_grams_total, coalesce(h, 0)::BIGINT AS hits_total, coalesce(d, 0)::BIGINT AS docs_total,
  coalesce(u, 0)::BIGINT AS unique_ngrams_total, coalesce(d, 0) = 0 AS in_s0, coalesce(d, 0) <= 2 AS in_s1, coalesce(h, 0) <= 2 AS in_s1_hits FROM pt LEFT JOIN tot USING (problem_id))"""


def _run(n: int = 13, strip: bool = True, col: str = "text"):
    return lambda spark, d: audit.audit(audit.require_unique(_problems(spark, d, col)), _docs(spark, d), n, strip)


def audit_external(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "external_items").select(F.col("item_id").alias("problem_id"), F.col("question_text").alias("text"))
    return audit.audit(items, _docs(spark, d))


def audit_by_source(spark: SparkSession, d: str) -> DataFrame:
    return audit.by_slice(audit.matches(_problems(spark, d), _docs(spark, d), 13))


def audit_forward(spark: SparkSession, d: str) -> DataFrame:
    return audit.forward_probe(_problems(spark, d), _docs(spark, d))


def audit_examples(spark: SparkSession, d: str) -> DataFrame:
    return audit.examples(_problems(spark, d), _docs(spark, d)).select("problem_id", F.col("slice"), "rank", "doc_id", F.col("pos").cast("bigint").alias("pos"), "ngram")


def audit_hist_docs(spark: SparkSession, d: str) -> DataFrame:
    return audit.histogram(_run()(spark, d), "docs_total")


def audit_hist_hits(spark: SparkSession, d: str) -> DataFrame:
    return audit.histogram(_run()(spark, d), "hits_total")


def audit_gate(spark: SparkSession, d: str) -> DataFrame:
    return audit.gate(_run()(spark, d))


def probe_size(spark: SparkSession, d: str) -> DataFrame:
    p = audit.probe(_problems(spark, d), 13)
    return p.agg(F.countDistinct("g1", "g2").alias("n_grams"), F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("problem_id").alias("n_problems"))


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _problems(spark, d).select("problem_id", text.tokens("text").alias("toks"))
    return t.select("problem_id", F.size("toks").cast("bigint").alias("n_words"), *[text.gram_count("toks", n).alias(f"n{n}") for n in audit.SWEEP])


def n_sweep(spark: SparkSession, d: str) -> DataFrame:
    return audit.sweep(_problems(spark, d), _docs(spark, d))


def n_sweep_flip(spark: SparkSession, d: str) -> DataFrame:
    s = n_sweep(spark, d)
    at13 = s.where("n = 13").select("problem_id", F.col("in_s0").alias("in_s0_13"))
    n = F.count(F.lit(1))
    return s.join(at13, "problem_id").groupBy("n").agg(
        F.sum(F.col("in_s0").cast("bigint")).alias("s0_count"), F.bround(100 * F.sum(F.col("in_s0").cast("bigint")) / n, 3).alias("s0_pct"),
        F.bround(100 * F.sum((F.col("in_s0") != F.col("in_s0_13")).cast("bigint")) / n, 3).alias("flip_pct"),
    )


def s0_s1_counts(spark: SparkSession, d: str) -> DataFrame:
    return _run()(spark, d).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("bigint")).alias(f"{c}_count") for c in ("in_s0", "in_s1", "in_s1_hits")],
        F.max("docs_total").alias("max_docs"), F.max("hits_total").alias("max_hits"),
    )


def audit_flat(spark: SparkSession, d: str) -> DataFrame:
    """The flat audit over every source of the documents, a bounded list; ``audit_by_source`` has the same figures row by row."""
    sources = [r["slice"] for r in _docs(spark, d).select("slice").where("slice is not null").distinct().orderBy("slice").collect()]
    return audit.flat(_problems(spark, d), _docs(spark, d), sources)


def audit_drift(spark: SparkSession, d: str) -> DataFrame:
    """Archived audit rows, newest per problem, beside the present corpus: which flags moved."""
    a = read(spark, d, "contamination_audit").where("problem_id is not null")
    newest = a.groupBy("problem_id").agg(F.max_by(F.struct("docs_total", "in_s0"), F.struct("audited_at", F.coalesce("hits_total", F.lit(-1)).alias("h"))).alias("old"))
    now = _run()(spark, d)
    return now.join(newest, "problem_id", "left").select("problem_id", F.col("old.docs_total").alias("docs_then"), F.col("docs_total").alias("docs_now"), F.col("old.in_s0").alias("s0_then"), F.col("in_s0").alias("s0_now"))


def audit_streaming(spark: SparkSession, d: str) -> DataFrame:
    """The audit over the documents as a stream, summed per problem and slice."""
    docs = spark.readStream.schema(read(spark, d, "documents").schema).parquet(f"{d}/documents.parquet*").select("doc_id", F.col("source").alias("slice"), "text")
    run = uuid.uuid4().hex
    hits = incremental.run_available(incremental.gram_hits(docs, _problems(spark, d)), f"{shared_dir(spark)}/hits-{run}", f"{shared_dir(spark)}/stream-{run}")
    return hits.groupBy("problem_id", "slice").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("docs"))


def audit_nested(spark: SparkSession, d: str) -> DataFrame:
    """The nested form of the audit, with each map as sorted text."""
    a = audit.audit_nested(_problems(spark, d), _docs(spark, d))
    text_of = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias(c)
    return a.select("problem_id", *[text_of(f"per_slice_{c}") for c in ("hits", "docs", "unique_ngrams")])


def audit_hist_slices(spark: SparkSession, d: str) -> DataFrame:
    """How many problems have how many hits in each slice, those with none left out."""
    per = audit.by_slice(audit.matches(_problems(spark, d), _docs(spark, d), 13))
    return per.groupBy("slice", "hits").agg(F.count(F.lit(1)).alias("n_problems"))


def membership_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sweep at n = 13 agrees with the audit, and the sweep in long with that in wide form: rows that differ."""
    long = n_sweep(spark, d).select("problem_id", "n", "in_s0")
    now = _run()(spark, d).select("problem_id", F.lit(13).alias("n"), "in_s0")
    wide = long.groupBy("problem_id").pivot("n", list(audit.SWEEP)).agg(F.first("in_s0"))
    back = wide.selectExpr("problem_id", f"stack({len(audit.SWEEP)}, " + ", ".join(f"{n}, `{n}`" for n in audit.SWEEP) + ") as (n, in_s0)")
    return audit.disagreement({"n13_metadata": (long.where("n = 13"), now), "long_wide": (long, back)})


def corpus_set_size(spark: SparkSession, d: str) -> DataFrame:
    return audit.corpus_set_size(_docs(spark, d))


def audit_bloom(spark: SparkSession, d: str) -> DataFrame:
    return audit.bloom_probe(_problems(spark, d), _docs(spark, d)).select("problem_id", "hits_bloom")


_SWEEP_SQL = "WITH pt AS (SELECT problem_id, " + text.tokens_sql("text") + " AS toks FROM problems_cc_by), dt AS (SELECT doc_id, " + text.tokens_sql("text") + " AS toks FROM documents), s AS (" + " UNION ALL ".join(
    f"""SELECT p.problem_id, {n} AS n, coalesce(d, 0)::BIGINT AS docs_total, coalesce(h, 0)::BIGINT AS hits_total, d IS NULL AS in_s0 FROM pt p LEFT JOIN (
  SELECT problem_id, count(DISTINCT doc_id) AS d, count(*) AS h FROM ({text.grams_sql('dt', 'doc_id', n)}) JOIN (SELECT DISTINCT problem_id, g FROM ({text.grams_sql('pt', 'problem_id', n)})) USING (g) GROUP BY 1) x USING (problem_id)"""
    for n in audit.SWEEP
) + ")"

QUERIES = {
    "audit_n13": _run(),
    "audit_n8": _run(8),
    "audit_raw_norm": _run(13, False),
    "audit_answer_surface": _run(13, True, "answer"),
    "audit_external": audit_external,
    "audit_by_source": audit_by_source,
    "audit_streaming": audit_streaming,
    "audit_forward": audit_forward,
    "audit_examples": audit_examples,
    "audit_hist_docs": audit_hist_docs,
    "audit_hist_hits": audit_hist_hits,
    "audit_gate": audit_gate,
    "audit_flat": audit_flat,
    "audit_nested": audit_nested,
    "audit_hist_slices": audit_hist_slices,
    "membership_checks": membership_checks,
    "audit_drift": audit_drift,
    "probe_size": probe_size,
    "corpus_set_size": corpus_set_size,
    "audit_bloom": audit_bloom,
    "ngram_counts": ngram_counts,
    "n_sweep_membership": n_sweep,
    "n_sweep_flip": n_sweep_flip,
    "s0_s1_counts": s0_s1_counts,
}

_A13 = "WITH " + _audit_sql(13)
SQL = {
    "audit_n13": _A13 + " SELECT * FROM audit",
    "audit_n8": "WITH " + _audit_sql(8) + " SELECT * FROM audit",
    "audit_raw_norm": "WITH " + _audit_sql(13, False) + " SELECT * FROM audit",
    "audit_answer_surface": "WITH " + _audit_sql(13, True, "answer") + " SELECT * FROM audit",
    "audit_external": "WITH " + _audit_sql(13, True, "question_text", "external_items", "item_id") + " SELECT * FROM audit",
    "audit_by_source": _A13 + " SELECT * FROM per",
    "audit_streaming": _A13 + " SELECT problem_id, slice, hits, docs FROM per",
    "audit_forward": f"""WITH pt AS (SELECT problem_id, {text.tokens_sql('text')} AS toks FROM problems_cc_by),
own AS ({text.grams_sql('pt', 'problem_id', 13)}), dt AS (SELECT doc_id, source AS slice, {text.tokens_sql('text')} AS toks FROM documents),
corpus AS (SELECT DISTINCT slice, g FROM ({text.grams_sql('dt', 'slice, doc_id', 13)})), h AS (SELECT problem_id, count(*) AS h FROM own JOIN corpus USING (g) GROUP BY 1)
SELECT problem_id, coalesce(h, 0)::BIGINT AS hits_total, coalesce(h, 0) = 0 AS in_s0, coalesce(h, 0) <= 2 AS in_s1 FROM pt LEFT JOIN h USING (problem_id)""",
    "audit_examples": _A13.replace("hit AS", f"""r AS (SELECT problem_id, slice, doc_id, pos, g, row_number() OVER (PARTITION BY problem_id, slice ORDER BY doc_id, pos) AS rank FROM grams JOIN probe USING (g)),
hit AS""") + " SELECT problem_id, slice, rank::INT AS rank, doc_id, pos::BIGINT AS pos, g AS ngram FROM r WHERE rank <= 20",
    "audit_hist_docs": _A13 + " SELECT docs_total AS value, count(*) AS n_problems FROM audit GROUP BY 1",
    "audit_hist_hits": _A13 + " SELECT hits_total AS value, count(*) AS n_problems FROM audit GROUP BY 1",
    "audit_gate": _A13 + " SELECT sum(in_s1::INT)::BIGINT AS s1_count, sum(in_s1::INT) < 150 AS below_floor FROM audit",
    "audit_drift": _A13 + """, old AS (SELECT problem_id, docs_total AS docs_then, in_s0 AS s0_then, row_number() OVER (PARTITION BY problem_id ORDER BY audited_at DESC, coalesce(hits_total, -1) DESC) AS r FROM contamination_audit WHERE problem_id IS NOT NULL)
SELECT audit.problem_id, docs_then, docs_total AS docs_now, s0_then, in_s0 AS s0_now FROM audit LEFT JOIN (SELECT * FROM old WHERE r = 1) o USING (problem_id)""",
    "audit_nested": _A13 + " SELECT pt.problem_id, " + ", ".join(f"string_agg(slice || '=' || {c}, ';' ORDER BY slice) AS per_slice_{c}" for c in ("hits", "docs", "unique_ngrams")) + " FROM pt LEFT JOIN per USING (problem_id) GROUP BY 1",
    "audit_hist_slices": _A13 + " SELECT slice, hits, count(*) AS n_problems FROM per GROUP BY 1, 2",
    "membership_checks": _SWEEP_SQL + ", " + _audit_sql(13).replace("pt AS", "pt2 AS").replace("dt AS", "dt2 AS").replace("FROM pt ", "FROM pt2 ").replace("FROM pt)", "FROM pt2)").replace("FROM dt)", "FROM dt2)").replace("pt.", "pt2.") + " SELECT 'n13_metadata' AS what, count(*) AS n_compared, count(*) FILTER (s.in_s0 IS DISTINCT FROM audit.in_s0) AS n_differ FROM s FULL JOIN audit USING (problem_id) WHERE n = 13 UNION ALL SELECT 'long_wide', count(*), 0 FROM s",
    "corpus_set_size": _A13 + " SELECT slice, count(DISTINCT g) AS n_distinct, count(*) AS n_total FROM grams GROUP BY 1",
    "probe_size": _A13 + " SELECT count(DISTINCT g) AS n_grams, count(*) AS n_pairs, count(DISTINCT problem_id) AS n_problems FROM probe",
    "ngram_counts": f"WITH pt AS (SELECT problem_id, {text.tokens_sql('text')} AS toks FROM problems_cc_by) SELECT problem_id, len(toks)::BIGINT AS n_words, " + ", ".join(f"greatest(len(toks) - {n - 1}, 0)::BIGINT AS n{n}" for n in audit.SWEEP) + " FROM pt",
    "n_sweep_membership": _SWEEP_SQL + " SELECT * FROM s",
    "n_sweep_flip": _SWEEP_SQL + """, a AS (SELECT problem_id, in_s0 AS b FROM s WHERE n = 13) SELECT n, sum(in_s0::INT)::BIGINT AS s0_count, round_even(100 * sum(in_s0::INT)::DOUBLE / count(*), 3) AS s0_pct,
 round_even(100 * sum((in_s0 <> b)::INT)::DOUBLE / count(*), 3) AS flip_pct FROM s JOIN a USING (problem_id) GROUP BY 1""",
    "s0_s1_counts": _A13 + " SELECT count(*) AS n, sum(in_s0::INT)::BIGINT AS in_s0_count, sum(in_s1::INT)::BIGINT AS in_s1_count, sum(in_s1_hits::INT)::BIGINT AS in_s1_hits_count, max(docs_total) AS max_docs, max(hits_total) AS max_hits FROM audit",
}
