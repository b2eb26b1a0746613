"""Problem 1: text cut off by field limits.

Two operators:

``prefix_links``   values that are a strict prefix of a longer value elsewhere
                   (range-sorted self-join by prefix);
``mark_truncated`` values whose last sentence, formula, code block or answer
                   line is not complete.

A cut answer whose twin was never stored whole has no longer copy, so the
prefix join alone cannot find it; see README, problem 1. The prefix join stands
beside the ending test in the report, which says how many cut values it
confirms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchsieve.session import stage_table

TERMINAL = ".!?。！？;；:"
#: Words right before a bare formula or letter which say that it is the result, so that it may end the text.
CONCLUDES = re.compile(
    r"(?:\b(?:answer|answers|result|results|option|choice|obtain|obtains|solution|is|are|equals|q\.?e\.?d|antwort|ergebnis|lösung|lautet|ergibt|ist"
    r"|réponse|résultat|donc|est|respuesta|resultado|tanto|es)\b|答案|结果|因此|所以|[=:：是为])[^\w]*$",
    re.I,
)
#: Words which do so at the head of a short sentence.
FOLLOWS = re.compile(r"^\W*(?:therefore|hence|thus|so|also|donc|luego)\b(?:\W+\w+){0,3}\W*$|(?:因此|所以)[^，。]{0,8}$", re.I)
NOTICE = re.compile(
    r"(?:[\[(<{*_~-]\s*|\b)(?:output|token|tokens|length|size|char(?:acter)?s?|context|connection|stream|response|message|text|max\w*|request|generation|transfer|download)\b"
    r"[^\n\]\[)]{0,40}\b(?:limit|reached|closed|cut|truncated|lost|reset|aborted|interrupted|ended|exceeded|dropped|timed? ?out|stopped|incomplete)\b[^\n\]\[)]{0,40}[\])>}*_~.…\s-]*$"
    r"|[\[(<{]\s*(?:\.{3}|…|truncated|cut off|cut|timeout|eof|abgeschnitten|tronqué|truncado|截断|continued?|more)[^\n\]\[)]{0,40}[\])>}]\s*$",
    re.I,
)
HINT = re.compile(r"[\[(<{]|(?:reached|closed|truncated|interrupted|exceeded|aborted|incomplete|limit)[\])>}*_~.…\s-]*$", re.I)
ELLIPSIS = re.compile(r"(?:…|\.{3,}|�)+\s*$")
#: Words that end no sentence.
OPEN_WORD = re.compile(r"\b(?:the|an|of|to|and|or|in|for|with|is|are|by|that|which|der|die|das|und|mit|le|les|des|et|el|los|del|y)$", re.I)
FENCE = re.compile(r"^\s*(```|~~~)", re.M)
ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}")
ONE_TAG_END = re.compile(r"(?:</?[A-Za-z][^<>]*>|<!--[^<>]*-->|&nbsp;|\s)$")
TEX_END = re.compile(
    r"(?:\\end\{[A-Za-z]+\*?\}|\\(?:qed|hfill|newline|par|medskip|smallskip|bigskip|square|blacksquare)\b|\\\\|\\label\{[^{}]*\}|\\footnote\{[^{}]*\}|\\cite\{[^{}]*\}|~?\\ref\{[^{}]*\})\s*$"
)
WRAP_END = re.compile(r"(?:\*\*|__|\*|_|~~|'''|''|\|\}|\}\}|\]\]|\||`)\s*$")
CLOSE = "\"'”’»)]）】」』"
FORMULA = re.compile(r"\$\$.*?\$\$|\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]", re.S)
SENTENCE = re.compile(r"(?<=[.!?;])\s+|[。！？；]|\n+")
HALF_TAG = re.compile(r"</?[A-Za-z]*$|&[a-z#0-9]{1,6}$")
EMPTY_TAG = re.compile(r"<(?:ref|pre|code|table|ol|ul|div|p|i|b|td|tr|li)\b[^<>]*$", re.I)


def _at_end(rx: re.Pattern[str], s: str, reach: int = 240) -> re.Match[str] | None:
    """``rx`` searched near the end only; its matches there are shorter than ``reach``."""
    return rx.search(s, max(0, len(s) - reach))


def _open_brace(s: str) -> bool:
    """An opening brace of a TeX command that is never closed."""
    if s.count("{") == s.count("}"):
        return False
    depth = 0
    for m in re.finditer(r"\\.|[{}]", s, re.S):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
    return depth > 0


def cut_reason(text: str | None) -> str | None:
    """Why ``text`` counts as cut, or None for complete, blank and null texts.

    ``formula``  a formula or brace is open at the end;
    ``code``     a fenced or verbatim block is open;
    ``markup``   the text ends inside a tag or command;
    ``sentence`` the last sentence or line just stops.

    A trace of the break (a notice in brackets, an ellipsis, a replacement
    character) is taken off first; what stands before it decides, except that a
    replacement character always is a cut.
    """
    if text is None:
        return None
    s = text.strip("​﻿ \t\r\n\f\v\xa0")
    if not s:
        return None
    traced = False
    broken = False
    while True:
        got = _at_end(NOTICE, s, 120) if _at_end(HINT, s, 120) else None
        # a notice stands on its own or in brackets; a sentence which speaks of limits is none
        if got and (got[0].lstrip()[:1] in "[(<{" or s[: got.start()].endswith("\n")) and s[: got.start()].strip():
            s, traced = s[: got.start()].rstrip(), True
            continue
        got = _at_end(ELLIPSIS, s, 12)
        if got and s[: got.start()].strip():
            broken = broken or "�" in got[0]
            s, traced = s[: got.start()].rstrip(), True
            continue
        break
    if broken:
        return "sentence"
    if ("```" in s or "~~~" in s) and len(FENCE.findall(s)) % 2:
        return "code"
    open_env: list[str] = []
    for kind, name in ENV.findall(s) if "\\begin" in s else ():
        if kind == "begin":
            open_env.append(name.rstrip("*"))
        elif open_env and open_env[-1] == name.rstrip("*"):
            open_env.pop()
    if open_env and open_env[-1] in ("verbatim", "lstlisting", "minted"):
        return "code"
    if open_env and open_env[-1] in ("align", "equation", "gather", "multline", "displaymath", "eqnarray"):
        return "formula"
    plain = s.replace("\\$", "  ")
    if plain.count("$") % 2 or plain.count("\\(") > plain.count("\\)") or plain.count("\\[") > plain.count("\\]"):
        return "formula"
    if "\\" in plain and plain.count("{") != plain.count("}"):
        outside = FORMULA.sub(" ", plain)
        if "\\" in outside and _open_brace(outside):
            return "formula"
    if s[-1] in ".!?。！？" and not traced:
        return None
    if _at_end(EMPTY_TAG, s) or _at_end(HALF_TAG, s, 40):
        return "markup"
    if "<pre" in s.lower() and len(re.findall(r"<pre\b", s, re.I)) > len(re.findall(r"</pre>", s, re.I)):
        return "code"
    # take trailing markup off
    bare = s
    closed = False
    while True:
        before = bare
        while (got := _at_end(ONE_TAG_END, bare)) is not None:
            bare = bare[: got.start()].rstrip()
        if before.rstrip().lower().endswith("</ref>"):
            bare = bare[: max(bare.lower().rfind("<ref"), 0)].rstrip() or bare
        got = _at_end(TEX_END, bare)
        if got:
            closed = closed or got[0].startswith(("\\end{align", "\\end{verb", "\\end{eq", "\\end{lst", "\\end{gath", "\\end{disp", "\\qed"))
            bare = bare[: got.start()].rstrip()
        if closed:
            return None
        got = _at_end(WRAP_END, bare, 12)
        if got:
            bare = bare[: got.start()].rstrip()
        if bare == before:
            break
    if re.search(r"(```|~~~)\s*$", s) or re.search(r"</(pre|code|table|math)>\s*$", s, re.I):
        return None
    if not bare:
        return None
    if re.search(r"\\[A-Za-z]+\*?$", bare) or bare.endswith("\\"):
        return "markup"
    if bare[-1] in ".!?。！？":
        return None
    while bare and bare[-1] in CLOSE:
        if len(bare) > 1 and bare[-2] in ".!?。！？":
            return None
        bare = bare[:-1]
    bare = bare.rstrip()
    if not bare:
        return None
    line = bare.split("\n")[-1]
    last = FORMULA.sub("$F$", SENTENCE.split(FORMULA.sub(lambda m: m[0].replace(".", "·").replace("\n", " "), line))[-1]).strip() if line else ""
    last = last.strip("*_>|#+-• ").strip()
    if re.search(r"\|\s*", last):
        last = last.split("|")[-1].strip() or last
    whole = len(re.sub(r"<[^<>]*>", "", s).strip())
    ends_math = last.endswith("$F$") or bool(re.search(r"\\boxed\s*\{.*\}?$", last)) or last.endswith("}")
    if ends_math:
        head = re.sub(r"(\$F\$|\\boxed\s*\{.*)$", "", last).strip()
        if not head or CONCLUDES.search(head) or FOLLOWS.search(head) or "\\boxed" in last:
            return None
        return "sentence" if whole > 60 or traced else None
    got = re.search(r"(?:^|[\s:：(*])\(?[A-Ha-h]$", last)
    if got and (CONCLUDES.search(last[: got.start()]) or FOLLOWS.search(last[: got.start()]) or len(last) <= 3):
        return None
    if re.search(r"[:：]\s*\S{1,24}$", last) and re.search(r"answer|result|option|antwort|ergebnis|réponse|résultat|respuesta|resultado|答案|结果", last, re.I):
        return None
    words = re.findall(r"[㐀-鿿]|[^\W㐀-鿿]+", last)
    if whole <= 40 and len(words) <= 4 and not OPEN_WORD.search(last) and not traced and line == bare:
        return None  # a bare short answer
    return "sentence"


def mark_truncated(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``cut_reason`` (null: complete), one row per input row.

    Null and blank texts are complete by definition; repeated rows count each;
    other columns are not read, so clashing names do no harm. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rid": b["rid"], "cut_reason": [cut_reason(x) for x in b["value"]]})

    rows = df.select(F.col(id_col).alias("rid"), F.col(text_col).alias("value"))
    kind = rows.schema["rid"].dataType.simpleString()
    return rows.mapInPandas(run, f"rid {kind}, cut_reason string").withColumnRenamed("rid", id_col)


def prefix_links(df: DataFrame, text_col: str, min_chars: int = 1) -> DataFrame:
    """Distinct values of at least ``min_chars`` signs that are strict prefixes of a longer value.

    Columns ``value_hash`` (xxhash64 of the value) and ``value``. Copies are
    folded before the sort. The values are range-partitioned and sorted, so
    equal beginnings meet whatever their number and no bucket of a hot prefix
    is gathered in one task; in sorted order a value is a strict prefix of some
    other value exactly if it is one of its successor. The last value of each
    partition meets the first of the next in a table of two rows a partition.
    """
    values = df.select(F.col(text_col).alias("value")).where(F.length("value") >= min_chars).distinct()
    parts = max(1, values.sparkSession.sparkContext.defaultParallelism)
    ordered = values.repartitionByRange(parts, "value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        part = 0
        first = True
        for b in batches:
            out: list[tuple[str, int, str]] = []
            for v, part in zip(b["value"], b["part"]):
                if first:
                    out.append((v, part, "first"))
                    first = False
                if held is not None and v.startswith(held):
                    out.append((held, part, "link"))
                held = v
            yield pd.DataFrame(out, columns=["value", "part", "what"])
        if held is not None:
            yield pd.DataFrame([(held, part, "last")], columns=["value", "part", "what"])

    seen = stage_table(ordered.mapInPandas(run, "value string, part int, what string"), "prefix-links")
    edge = seen.where("what <> 'link'")
    nxt = F.lead(F.when(F.col("what") == "first", F.col("value"))).over(Window.orderBy("part", F.col("what") == "last"))
    across = edge.withColumn("nxt", nxt).where((F.col("what") == "last") & F.col("nxt").startswith(F.col("value"))).select("value")
    return seen.where("what = 'link'").select("value").unionByName(across).distinct().withColumn("value_hash", F.xxhash64("value"))


def truncation_report(df: DataFrame, id_col: str, text_col: str, source_col: str, archived: DataFrame | None = None) -> DataFrame:
    """Per source: n_total, n_truncated, trunc_rate, n_longer_copy; beside the archived figures.

    One pass over the texts marks them, another sorts them for the prefix join.
    Sources are compared without case and outer spaces; a null source is its own
    row. Archived rates in percent (over 1) are divided by 100; where the
    archived count or rate is null it stays null.
    """
    key: Column = F.lower(F.trim(F.col(source_col)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"source_key": b["source_key"], "value_hash": b["value_hash"], "cut": [cut_reason(x) is not None for x in b["value"]]})

    rows = df.select(key.alias("source_key"), F.xxhash64(F.col(text_col)).alias("value_hash"), F.col(text_col).alias("value"))
    marked = rows.mapInPandas(run, "source_key string, value_hash bigint, cut boolean")
    # repeated texts of a source are added up before they meet the links, so no hot text is one group of rows
    per = marked.groupBy("source_key", "value_hash").agg(F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("n_cut"))
    links = prefix_links(df, text_col).select("value_hash", F.lit(1).alias("longer"))
    out = per.join(links, "value_hash", "left").groupBy("source_key").agg(
        F.sum("n").alias("n_total"), F.sum("n_cut").alias("n_truncated"), F.coalesce(F.sum(F.when(F.col("longer") == 1, F.col("n_cut"))), F.lit(0)).alias("n_longer_copy")
    )
    out = out.withColumn("trunc_rate", F.col("n_truncated") / F.col("n_total"))
    if archived is not None:
        old = archived.groupBy(F.lower(F.trim(F.col(source_col))).alias("old_key")).agg(
            F.max("n_truncated").alias("archived_n_truncated"),
            F.max(F.when(F.col("trunc_rate") > 1, F.col("trunc_rate") / 100).otherwise(F.col("trunc_rate"))).alias("archived_trunc_rate"),
        )
        out = out.join(F.broadcast(old), F.col("source_key").eqNullSafe(F.col("old_key")), "left").drop("old_key")
    return out.withColumnRenamed("source_key", source_col)
