"""Reading problems, corpora, verdicts and id lists from files."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_FIELDS = ("text", "content", "raw_content")
CORPUS_SCHEMA = "text string, content string, raw_content string, _bad string"


def slice_spec(spec: str) -> tuple[str, str]:
    """``name:source``, parted at the first colon."""
    name, colon, source = spec.partition(":")
    if not colon or not name or not source:
        raise ValueError(f"a slice is given as name:source, not {spec!r}")
    return name, source


def read_slice(spark: SparkSession, spec: str) -> DataFrame:
    """``slice``, ``doc_id``, ``text`` of all ``.jsonl``, ``.jsonl.gz`` and ``.jsonl.zst`` files under a folder.

    Lines that are no JSON are left out, as are documents without text; the text
    is the first of text, content and raw_content that is not empty. ``doc_id``
    is file name and a number unique in the read. A hub name cannot be read
    without a network and is an error, not an empty slice.
    """
    name, source = slice_spec(spec)
    if "://" not in source and not source.startswith(("/", "./", "../")):
        raise ValueError(f"slice {name}: {source!r} is no path; hub sources are not read")
    if "://" not in source and not os.path.exists(source):
        raise FileNotFoundError(source)
    lines = (
        spark.read.schema(CORPUS_SCHEMA)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonl,jsonl.gz,jsonl.zst}")
        .json(source)
    )
    full = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in TEXT_FIELDS])
    return lines.where("_bad is null").select(
        F.lit(name).alias("slice"), F.concat_ws("#", F.col("_metadata.file_name"), F.monotonically_increasing_id().cast("string")).alias("doc_id"), full.alias("text")
    ).where("text is not null")


def read_slices(spark: SparkSession, specs: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (read_slice(spark, s) for s in specs))


def read_problems(spark: SparkSession, path: str, schema: str = "problem_id string, text string") -> DataFrame:
    """Problems from JSON lines; a malformed line fails the read, as does a record without id or text."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a problem without {c}"))).otherwise(F.col(c)).alias(c)
    return rows.select(*[need(c) if c in ("problem_id", "text") else F.col(c) for c in rows.columns])


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts from JSON lines; blank lines and null verdicts are left out, missing flags are false and 0."""
    rows = spark.read.schema("model string, problem_id string, is_correct boolean, in_S0 boolean, in_S1 boolean, hits_total int, candidate string, rationale string").json(path)
    zero = {"in_s0": F.coalesce("in_S0", F.lit(False)), "in_s1": F.coalesce("in_S1", F.lit(False)), "hits_total": F.coalesce("hits_total", F.lit(0))}
    return rows.where("is_correct is not null").select("model", "problem_id", F.col("is_correct").cast("bigint").alias("is_correct"), *[v.alias(k) for k, v in zero.items()], "candidate", "rationale")


def read_optional_verdicts(spark: SparkSession, path: str | None) -> DataFrame | None:
    """``model``, ``problem_id``, ``is_correct`` from CSV, or None if there is no such file or it lacks a column."""
    if not path or "://" not in path and not os.path.exists(path):
        return None
    rows = spark.read.option("header", True).csv(path)
    if not {"model", "problem_id", "is_correct"} <= set(rows.columns):
        return None
    return rows.select("model", "problem_id", F.col("is_correct").try_cast("bigint").alias("is_correct")).dropna()


def read_membership(spark: SparkSession, path: str, ns: tuple[int, ...] = (8, 10, 12, 13, 15)) -> DataFrame:
    """``problem_id``, ``n``, ``in_s0`` from the wide CSV with a column in_S0_n… of True and False for each n."""
    wide = spark.read.option("header", True).option("lineSep", "\n").csv(path)
    wide = wide.toDF(*[c.strip() for c in wide.columns])
    pairs = ", ".join(f"{n}, `in_S0_n{n}`" for n in ns)
    return wide.selectExpr("problem_id", f"stack({len(ns)}, {pairs}) as (n, flag)").select("problem_id", "n", (F.trim(F.regexp_replace("flag", "\r", "")) == "True").alias("in_s0"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``problem_id`` from a JSON array of strings or numbers."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("problem_id"))


def label_views(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``files`` with ``view`` from parts of ``path``: the first rule whose part the path contains; others are left out."""
    label = F.coalesce(*[F.when(F.contains("path", F.lit(part)), F.lit(name)) for part, name in rules])
    return files.withColumn("view", label).where("view is not null")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and ``n_lines`` of the files under ``path``."""
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_lines"))


def read_audit_labels(spark: SparkSession, root: str, expected: int, ns: tuple[int, ...] = (8, 10, 12, 13, 15)) -> DataFrame:
    """``problem_id``, ``n``, ``in_s0`` from the folders ``audit-n8``, ``audit-n10`` and so on under ``root``.

    Each must hold ``expected`` different problems, else the read fails.
    """
    parts = [spark.read.json(f"{root}/audit-n{n}/contamination-audit.jsonl").select("problem_id", F.lit(n).alias("n"), F.col("in_S0").cast("boolean").alias("in_s0")) for n in ns]
    rows = reduce(DataFrame.unionByName, parts)
    return require_counts(rows, "n", "problem_id", expected)


def require_counts(rows: DataFrame, group: str, key: str, expected: int) -> DataFrame:
    """``rows`` unless some ``group`` (a model, an n) has not exactly ``expected`` different keys, each once."""
    bad = rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys")).where((F.col("rows") != expected) | (F.col("keys") != expected))
    first = bad.orderBy(group).limit(1).collect()
    if first:
        raise ValueError(f"{group} {first[0][0]}: {first[0]['rows']} rows of {first[0]['keys']} different {key}, not {expected}")
    return rows


def read_withheld(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The manifest of withheld problems (CSV with a header), of one split if given."""
    rows = spark.read.option("header", True).csv(path)
    return rows if split is None else rows.where(F.lower(F.trim("split")) == split.strip().lower())


def work_list(manifest: DataFrame) -> DataFrame:
    """The papers of a manifest that are to be fetched: different ``paper_id`` and ``arxiv_id`` in order."""
    return manifest.select("paper_id", "arxiv_id").distinct().orderBy("paper_id", "arxiv_id")
