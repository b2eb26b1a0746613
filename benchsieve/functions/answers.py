"""Final answers in text: boxed parts, option letters, normal form and exact match."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.text import WS, WS_SQL

#: What the normal form deletes, in this order.
STYLE = ["\\mathbf", "\\boldsymbol", "\\mathrm", "\\mathsf", "\\mathcal", "\\operatorname", "\\text"]
LAYOUT = ["\\left", "\\right", "\\,", "\\!", "\\;", "\\:", "\\quad", "\\qquad", "\\boxed"]
KEPT = r"[^a-z0-9\\{}_^+\-*/=<>.,()\[\]]"
#: How an option is announced, most telling first.
LETTER = [
    r"(?i)final answer is\s*[:\-]?\s*\**\(?([ABCD])\)?",
    r"(?i)answer is\s*[:\-]?\s*\**\(?([ABCD])\)?",
    r"(?i)option\s+([ABCD])",
    r"(?i)\b([ABCD])\s*(?:is correct|\(correct\))",
]


#: A letter that stands alone; what a word sign is differs between engines, so it is spelled out.
ALONE = r"(?<![\p{L}\p{N}_])([ABCD])(?![\p{L}\p{N}_])"
#: Letters beyond ASCII, which the SQL twin turns into plain ones so that its word bounds agree.
LETTERS_SQL = r"[\x{c0}-\x{24f}\x{370}-\x{52f}\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"


def normal_form(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    c = F.replace(F.lower(c), F.lit("−"), F.lit("-"))
    for s in STYLE + LAYOUT:
        c = F.replace(c, F.lit(s), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, WS, ""), KEPT, "")
    return F.translate(c, "{}", "")


def normal_form_sql(col: str) -> str:
    x = f"replace(lower({col}), '−', '-')"
    for s in STYLE + LAYOUT:
        x = f"replace({x}, '{s}', '')"
    x = f"regexp_replace(regexp_replace({x}, '{WS_SQL}', '', 'g'), '{KEPT}', '', 'g')"
    return f"replace(replace({x}, '{{', ''), '}}', '')"


_BRACE = re.compile(r"[{}]")


def boxed(text: str | None) -> list[str]:
    """Contents of the outermost balanced boxes, in order; a box that never closes is passed over."""
    found: list[str] = []
    at = 0
    while text and (at := text.find("\\boxed", at)) >= 0:
        opens = text.find("{", at + 6)
        if opens < 0:
            break
        depth = 0
        ends = None
        for m in _BRACE.finditer(text, opens):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                ends = m.start()
                break
        if ends is None:
            at = opens + 1
        else:
            found.append(text[opens + 1 : ends])
            at = ends + 1
    return found


def with_boxes(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``, the boxed parts of a text. Braces nest, so this is no job for a regular expression."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(boxed)

    return df.withColumn(out, run(F.col(text_col)))


def letter(text_col: str, boxes_col: str) -> Column:
    """The option letter a text settles on: the last announcement of the most telling kind, else the last box with a letter, else the last letter near the end; or ''."""
    text = F.col(text_col)
    last = lambda c: F.element_at(c, -1)
    kinds = [F.try_element_at(F.regexp_extract_all(text, F.lit(p.replace(r"\b", r"(?<![\p{L}\p{N}_])")), F.lit(1)), F.lit(-1)) for p in LETTER]
    in_boxes = F.filter(F.transform(F.col(boxes_col), lambda b: F.regexp_extract(b, "(?i)" + ALONE, 1)), lambda x: x != "")
    tail = F.regexp_extract_all(F.right(text, F.lit(400)), F.lit(ALONE), F.lit(1))
    return F.upper(F.coalesce(*kinds, F.when(F.size(in_boxes) > 0, last(in_boxes)), F.when(F.size(tail) > 0, last(tail)), F.lit("")))


def boxes_sql(source: str, name: str) -> str:
    """CTEs up to ``name`` (id, p, box): the boxes of ``source`` (id, txt) and their places, found by the running depth of braces.

    A box ends where the depth first falls below that after its brace; one that
    starts before an earlier box has ended is part of it.
    """
    return f"""{name}_c AS (SELECT id, txt, unnest(range(1, length(txt) + 1)) AS pos FROM {source} WHERE contains(txt, '\\boxed')),
{name}_b AS (SELECT id, pos, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY pos) AS depth, c FROM (SELECT id, pos, substr(txt, pos, 1) AS c FROM {name}_c) WHERE c IN ('{{', '}}')),
{name}_o AS (SELECT p.id, p.pos AS p, min(b.pos) AS o FROM {name}_c p JOIN {name}_b b ON b.id = p.id AND b.c = '{{' AND b.pos > p.pos + 5 WHERE substr(txt, p.pos, 6) = '\\boxed' GROUP BY 1, 2),
{name}_e AS (SELECT o.id, p, o, min(e.pos) AS e FROM {name}_o o JOIN {name}_b s ON s.id = o.id AND s.pos = o JOIN {name}_b e ON e.id = o.id AND e.pos > o AND e.depth = s.depth - 1 GROUP BY 1, 2, 3),
{name} AS (SELECT x.id, p, substr(txt, o + 1, e - o - 1) AS box FROM {name}_e x JOIN {source} t USING (id) WHERE NOT EXISTS (SELECT 1 FROM {name}_e y WHERE y.id = x.id AND y.p < x.p AND x.p < y.e))"""


def letter_sql(text: str, boxes: str) -> str:
    """The letter of ``text``, whose boxes are in the list ``boxes``."""
    plain = lambda x: f"regexp_replace({x}, '{LETTERS_SQL}', 'x', 'g')"
    text = plain(text)
    alone = chr(92) + "b([ABCD])" + chr(92) + "b"
    last = lambda p, x: f"list_extract(regexp_extract_all({x}, '{p}', 1), -1)"
    kinds = ", ".join(last(p, text) for p in LETTER)
    boxed_one = f"list_extract(list_filter(list_transform({boxes}, lambda b: regexp_extract({plain('b')}, '(?i){alone}', 1)), lambda x: x <> ''), -1)"
    return f"upper(coalesce({kinds}, {boxed_one}, {last(alone, f'right({text}, 400)')}, ''))"


def exact_sql(candidate: str, boxes: str, answer: str, answer_boxes: str, kind: str) -> str:
    """The condition of ``exact``; the boxes are lists."""
    refs = f"CASE WHEN len({answer_boxes}) > 0 THEN list_transform({answer_boxes}, lambda r: {normal_form_sql('r')}) ELSE [{normal_form_sql(f'coalesce({answer}, {chr(39) * 2})')}] END"
    own = f"list_transform({boxes}, lambda b: {normal_form_sql('b')})"
    met = f"list_reduce({own}, lambda n, b: CASE WHEN n::INT < len({refs}) AND ({refs})[n::INT + 1] = b THEN (n::INT + 1)::VARCHAR ELSE n END, '0')::INT = len({refs})"
    free = f"len(list_filter({refs}, lambda r: r = '' OR NOT contains({normal_form_sql(candidate)}, r))) = 0"
    choice = f"{letter_sql(candidate, boxes)} = upper(trim(coalesce({answer}, '')))"
    return f"coalesce(CASE WHEN coalesce({candidate}, '') = '' THEN false WHEN {kind} = 'MCQ' THEN {choice} WHEN len({boxes}) > 0 THEN {met} ELSE {free} END, false)"


def exact(df: DataFrame, candidate: str, answer: str, kind: str) -> DataFrame:
    """``df`` with ``exact_ok``: a null or empty candidate is wrong; a choice needs the same letter.

    Else the normal forms of the answer's boxes (or of the whole answer) must be
    an ordered subsequence of the candidate's boxes or, if it has none, all be
    parts of its normal form.
    """
    rows = with_boxes(with_boxes(df, candidate, "_cb"), answer, "_ab")
    refs = F.when(F.size("_ab") > 0, F.transform("_ab", normal_form)).otherwise(F.array(normal_form(F.coalesce(answer, F.lit("")))))
    boxes = F.transform("_cb", normal_form)
    rows = rows.withColumn("_refs", refs).withColumn("_boxes", boxes).withColumn("_plain", F.when(F.size("_cb") == 0, normal_form(candidate)))
    # how many references have been met, box by box
    met = F.aggregate("_boxes", F.lit(0), lambda n, b: F.when((n < F.size("_refs")) & (F.try_element_at("_refs", n + 1) == b), n + 1).otherwise(n))
    free = F.forall("_refs", lambda r: (r != "") & F.contains("_plain", r))
    text = F.when(F.size("_boxes") > 0, met == F.size("_refs")).otherwise(free)
    choice = letter(candidate, "_cb") == F.upper(F.trim(F.coalesce(answer, F.lit(""))))
    ok = F.when(F.coalesce(F.col(candidate), F.lit("")) == "", F.lit(False)).when(F.col(kind) == "MCQ", choice).otherwise(text)
    return rows.withColumn("exact_ok", F.coalesce(ok, F.lit(False))).drop("_cb", "_ab", "_refs", "_boxes", "_plain")
