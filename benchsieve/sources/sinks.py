"""Writing results: JSON lines, flat CSV, and a short summary."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_flat_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, flags as 0 and 1."""
    cols = [F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def fixed(c: str, places: int, sign: bool = False):
    """A number with so many places, half to even, signed if asked."""
    return F.format_string(f"%{'+' if sign else ''}.{places}f", F.bround(F.col(c).cast("double"), places))


def summary(audited: DataFrame, floor: int = 150, per_slice: DataFrame | None = None) -> str:
    """Markdown: sizes of the clean sets and histograms, also of the hits in each slice if given; what it gathers is one row a count."""
    t = audited.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(c) for c in ("in_s0", "in_s1", "in_s1_hits")]).first()
    lines = ["# Overlap audit", "", f"- problems: {t['n']}"]
    for c, name in (("in_s0", "no document"), ("in_s1", "at most two documents"), ("in_s1_hits", "at most two occurrences")):
        lines.append(f"- {name}: {t[c]} ({100 * t[c] / max(1, t['n']):.1f} %)")
    if t["in_s1"] < floor:
        lines.append(f"- warning: fewer than {floor} problems in at most two documents")
    for col in ("docs_total", "hits_total"):
        lines += ["", f"| {col} | problems |", "|---|---|"]
        lines += [f"| {r['v']} | {r['n']} |" for r in audited.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()]
    if per_slice is not None:
        lines += ["", "| slice | hits | problems |", "|---|---|---|"]
        lines += [f"| {r['slice']} | {r['hits']} | {r['n']} |" for r in per_slice.groupBy("slice", "hits").agg(F.count(F.lit(1)).alias("n")).orderBy("slice", "hits").collect()]
    return "\n".join(lines) + "\n"


def _cells(df: DataFrame, places: int) -> list[list[str]]:
    cell = lambda v: "" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    return [list(map(cell, r)) for r in df.collect()]


_TEX_SIGNS = str.maketrans({c: "\\" + c for c in "&%$#_{}"} | {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"})


def tex_table(df: DataFrame, places: int = 4) -> str:
    """A small result table for TeX."""
    rows = [" & ".join(x.translate(_TEX_SIGNS) for x in r) + r" \\" for r in [df.columns, *_cells(df, places)]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", rows[0], r"\hline", *rows[1:], r"\end{tabular}"]) + "\n"


def markdown_table(df: DataFrame, places: int = 4) -> str:
    """A small result table; floats with so many places."""
    rows = ["| " + " | ".join(r) + " |" for r in [df.columns, *_cells(df, places)]]
    return "\n".join([rows[0], "|" + "---|" * len(df.columns), *rows[1:]]) + "\n"


def stats_json(frames: dict[str, DataFrame]) -> str:
    """Release statistics as JSON: each frame, a small result table, as a list of records."""
    return json.dumps({k: [r.asDict(recursive=True) for r in df.collect()] for k, df in frames.items()}, sort_keys=True, default=str)
