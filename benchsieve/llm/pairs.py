"""Problem 5: broken prompt and response pairs.

A response is cut into clauses; a conditional random field tags each as answer,
refusal, echo, foreign or unfinished; the share of the response that each tag
covers gives the defect of the pair: no clause that says anything is ``empty``,
clauses of refusal without an answer are ``refusal``, nearly nothing but echo is
``copied``, mostly foreign clauses are ``language``, and an unfinished last
clause is ``truncated`` if the ending test of problem 1 agrees.

The field is fitted once per run on a bounded sample (``TRAIN_PAIRS`` pairs, of
each ``TRAIN_CLAUSES`` clauses at most): clauses of responses and questions
arranged into whole, echoing, foreign, cut and refusing responses, where the
arrangement gives the labels. Nothing is fitted on verdicts.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchsieve.llm.crf import Crf
from benchsieve.llm.truncation import FORMULA, cut_reason

#: Most pairs that the field is fitted on.
TRAIN_PAIRS = 400
#: Most clauses of a response or question that take part in fitting.
TRAIN_CLAUSES = 12
LABELS = ["answer", "refusal", "echo", "foreign", "unfinished"]
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)

PLACEHOLDER = re.compile(
    r"[\s\W_]*(?:n\s*/?\s*a|none|null|nil|nan|tbd|tba|todo|blank|empty|no (?:output|answer|response|content|text)|(?:the )?(?:final )?answer(?: is)?|response|output|solution"
    r"|antwort|réponse|respuesta|答案|undefined|unknown|missing|placeholder)?[\s\W_]*",
    re.I,
)
EMPTY_BOX = re.compile(r"\\boxed\s*\{\s*\}|\$\s*\$|<[^<>]*>|\\[a-z]+\{\s*\}")
#: A single line break after a long line which ends no sentence, or before a small letter or a formula, is one of a wrapped text.
CLAUSE = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？；])|\n[ \t]*\n\s*|(?<=:)\n|(?<![^\n]{28})\n(?![ \t]*[a-z\x02])|\n(?=[ \t]*(?:[-*#>|]|\d+[.)]\s))|(?<=>)(?=<)")
TEX_BITS = re.compile(r"\\[A-Za-z]+(?:_\w+)?|<[^<>]*>|&[a-z#0-9]+;")
WORD = re.compile(r"[^\W\d_]{2,}")
CJK = re.compile(r"[㐀-鿿]")
INABILITY = re.compile(
    r"\b(?:can(?:not|'t|’t| not)|could(?:n't|n’t| not)|won['’]t|will not|unable|not able|do(?:n['’]t| not) (?:do|have|provide|answer|solve|know|allow|offer|feel|think|give)"
    r"|decline|refuse|rather not|prefer not|must pass|have to pass|pass on this|not something i|outside (?:what|of what|my)|beyond my|too little (?:context|information|knowledge)|not enough (?:context|information|knowledge)"
    r"|prevents? me|not (?:allowed|permitted)|do not allow|unanswered|no (?:solution|answer|derivation) (?:can|could|will))\b"
    r"|kann (?:ich )?(?:\w+ ){0,4}nicht|nicht (?:beantworten|lösen|helfen)|nicht (?:möglich|in der lage)|muss (?:\w+ ){0,3}ablehnen|ne (?:peux|puis) pas|ne suis pas en mesure|(?:m['’]est )?impossible|refuser|no puedo|no me es posible|no es posible|no estoy en condiciones|无法|不能(?:回答|提供|帮|解)|拒绝|抱歉",
    re.I,
)
SELF = re.compile(r"\b(?:i|i'm|i’m|me|my|assistant|language model|ai)\b|\b(?:ich|mir|je|m|yo|puedo|estoy)\b|我|offered|context|guidelines|policy", re.I)
TASK = re.compile(r"\b(?:answer\w*|help|request|question|solve|solving|problem\w*|derivation\w*|attempt|solution|provide|work on|guess|do|offer\w*|unanswered|assist|allow)\b|beantworten|helfen|lösung|lösen|répondre|aider|réponse|résoudre|responder|ayudar|solución|resolver|respuesta|回答|帮助|解答|解决", re.I)
REGRET = re.compile(r"\b(?:sorry|apolog\w+|unfortunately|regret|forgive|thank you|appreciate|as an? (?:\w+ )?(?:assistant|model|ai)|leider|désolé|malheureusement|lo siento|lamentablemente)\b|抱歉|对不起|遗憾", re.I)
COURTESY = re.compile(r"\b(?:anything else|hope you understand|hope (?:this|that) helps|take care|please (?:rephrase|ask|consult|contact|try)|ask about something else|consult an?|check a textbook|may want to (?:check|look|ask)|guidelines|good luck|best wishes|feel free|let me know|have a (?:nice|good))\b", re.I)
HEDGE = re.compile(r"\b(?:but here|so i keep|earlier draft|here is|here's|instead|fully certain|further by hand|nevertheless|i will|let me|we cannot|i won't repeat|misread)\b", re.I)
LABEL = re.compile(r"\b(?:restat\w+|problem|question|asked?|following|background|prompt|task|aufgabe|frage|problème|problema|pregunta)\b[^.]{0,40}[:.]?\s*$|题目|问题", re.I)
CONCLUDE = re.compile(r"\\boxed|\b(?:answer|result|option|therefore|hence|thus|we obtain|completes|as claimed|q\.?e\.?d)\b|ergebnis|résultat|resultado|结果|答案", re.I)
#: What only an answer says, so that a refusal beside it is a hedge.
ANSWERS = re.compile(r"\\boxed\s*\{\s*[^\s}]|\b(?:answer|result|option|obtain|completes|as claimed|q\.?e\.?d)\b|ergebnis|résultat|resultado|结果|答案", re.I)
#: Frequent small words by language, fixed values.
SMALL = {
    "en": "the of and to in is that for with as by on are be this which from at an we it over when since so while its",
    "de": "der die das und ist von mit nicht den dem ein eine einer für auf zu im sich des wird wir aus bei bis sowie",
    "fr": "le la les de des et est une un du que en dans pour par sur avec qui ne pas au il se donc tant entre",
    "es": "el la los las de del y es una un que en por con para se al no lo como su entre hay queda mientras",
}
_LANGS = list(SMALL)
_OF_WORD: dict[str, list[int]] = {}
for _i, _words in enumerate(SMALL.values()):
    for _w in _words.split():
        _OF_WORD.setdefault(_w, []).append(_i)
#: A clause without any of these words cannot match the pattern of that name, so it is not tried; Han text always is.
CUES = {
    "unable": "can cannot could couldn won will unable able do don decline refuse rather prefer pass something outside beyond little enough prevent prevents not no allow unanswered "
    "kann nicht muss ne refuser impossible puedo posible estoy",
    "regret": "sorry apologies apologize apologise apologizes apology unfortunately regret forgive thank appreciate assistant model ai leider désolé malheureusement siento lamentablemente",
    "courtesy": "else hope care please consult textbook check look ask guidelines luck wishes feel know nice good",
    "hedge": "but so draft here instead certain hand nevertheless will let we won misread",
    "label": "restate restated restates restating restatement problem question ask asked following background prompt task aufgabe frage problème problema pregunta",
    "conclude": "answer result option therefore hence thus obtain completes claimed qed ergebnis résultat resultado",
}
_CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
ALL_WORDS = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+")


def _language(words: list[str]) -> str | None:
    hits = [0] * len(_LANGS)
    cjk = 0
    for w in words:
        got = _OF_WORD.get(w)
        if got is not None:
            for i in got:
                hits[i] += 1
        elif len(w) == 1 and "㐀" <= w <= "鿿":
            cjk += 1
    if cjk >= 4 and 2 * cjk >= len(words):
        return "zh"
    top = max(hits)
    return _LANGS[hits.index(top)] if top >= 2 and hits.count(top) == 1 else None


def language(text: str) -> str | None:
    """en, de, fr, es or zh by small words and script; None where too little is said."""
    return _language(ALL_WORDS.findall(text.lower()))


def _plain(text: str) -> str:
    return TEX_BITS.sub(" ", FORMULA.sub(" ", text))


def _units_of(words: list[str]) -> list[str]:
    return [w for w in words if len(w) >= 3 or "㐀" <= w <= "鿿"]


def _units(text: str) -> list[str]:
    """Words of a text in order; a Han sign is a word."""
    return _units_of(ALL_WORDS.findall(text.lower()))


def _bits(units: list[str]) -> set[str]:
    return set(units) | {a + b for a, b in zip(units, units[1:]) if len(a) == 1 or len(b) == 1}


def is_empty(text: str | None) -> bool:
    """Null, blank or a placeholder, nothing said."""
    if text is None:
        return True
    s = EMPTY_BOX.sub(" ", text) if "\\" in text or "$" in text or "<" in text else text
    return len(s) < 200 and bool(PLACEHOLDER.fullmatch(s))


#: Stands for a formula in a clause.
MARK = "\x02"


class Clause(NamedTuple):
    """A clause whose formulas are replaced by marks, and these formulas."""

    text: str
    formulas: list[str]

    def whole(self) -> str:
        parts = self.text.split(MARK)
        return parts[0] + "".join(f + p for f, p in zip(self.formulas, parts[1:]))

    def size(self) -> int:
        return len(self.text) + sum(map(len, self.formulas)) - len(self.formulas)


def clauses(text: str) -> list[Clause]:
    """Sentences and lines with formulas whole, in order; none is blank."""
    text = text.replace(MARK, " ")
    kept = FORMULA.findall(text) if "$" in text or "\\" in text else []
    out: list[Clause] = []
    at = 0
    for p in CLAUSE.split(FORMULA.sub(MARK, text) if kept else text):
        n = p.count(MARK) if kept else 0
        p = p.strip()
        if p:
            out.append(Clause(p, kept[at : at + n]))
        at += n
    return out


N_FEATURES = 18


_SIGNS = str.maketrans("", "", " \t\n\r$\\{}(),.")


class Question:
    """What the tagger needs of a question and its background."""

    __slots__ = ("bits", "asked", "math", "lang")

    def __init__(self, question: str | None, background: str | None) -> None:
        whole = f"{background or ''}\n{question or ''}"
        self.bits = _bits(_units(_plain(whole)))
        self.asked = set(_units(_plain(question or "")))
        self.math = {m.translate(_SIGNS) for m in FORMULA.findall(whole)}
        self.lang = language(_plain(question or whole))


def echo_share(units: list[str], q: Question) -> float:
    if not units or not q.bits:
        return 0.0
    cjk = sum(len(u) == 1 for u in units) > len(units) / 2
    if cjk:
        pairs = [a + b for a, b in zip(units, units[1:])]
        return sum(p in q.bits for p in pairs) / max(1, len(pairs))
    return sum(u in q.bits for u in units) / len(units)


QUOTED = re.compile(r"[\"“„«][^\"”“»]*[\"”“»]")


UNABLE, REGRETS, POLITE, ECHOES, OWN, LABELS_IT, OTHER_LANG, SAME_LANG, CONCLUDES, NEW_MATH, HAS_MATH = range(1, 12)


def features(parts: list[Clause], q: Question, cut: bool) -> tuple[list[tuple], list[str]]:
    """A row of zeros and ones for each clause, and all units of the text. A clause that is cut concludes nothing."""
    rows: list[tuple] = []
    said: list[str] = []
    last = len(parts) - 1
    for i, (p, formulas) in enumerate(parts):
        tex = "\\" in p
        has_math = bool(formulas) or tex or "$" in p
        plain = TEX_BITS.sub(" ", p) if tex or "<" in p or "&" in p else p
        words = ALL_WORDS.findall(plain.lower())
        have = set(words)
        han = any("㐀" <= w <= "鿿" for w in have)
        units = _units_of(words)
        said += units
        echo = echo_share(units, q)
        lang = _language(ALL_WORDS.findall(QUOTED.sub(" ", plain).lower()) if '"' in plain or "“" in plain or "«" in plain else words)
        new = [m for m in formulas if m.translate(_SIGNS) not in q.math]
        cue = lambda k: han or not have.isdisjoint(_CUES[k])  # noqa: B023, E731
        broken = cut and i == last
        hedge = cue("hedge") and bool(HEDGE.search(plain))
        rows.append((
            1,
            not has_math and not hedge and cue("unable") and bool(INABILITY.search(plain) and SELF.search(plain) and TASK.search(plain)),
            not has_math and cue("regret") and bool(REGRET.search(plain)),
            cue("courtesy") and bool(COURTESY.search(plain)),
            len(units) >= 4 and echo >= 0.85,
            len(units) >= 4 and echo < 0.6,
            len(plain) < 90 and cue("label") and bool(LABEL.search(plain)),
            lang is not None and q.lang is not None and lang != q.lang,
            lang is not None and lang == q.lang,
            not broken and ("\\boxed" in p or any("\\boxed" in m for m in formulas) or cue("conclude") and bool(CONCLUDE.search(p))),
            not broken and bool(new) and echo < 0.85,
            has_math,
            hedge,
            i == last,
            broken,
            len(units) < 3,
            i == 0,
            len(units) < 4 and echo >= (0.85 if units else 0) and not new and (bool(units) or has_math),
        ))
    return rows, said


def _training(pairs: list[tuple[str, str | None, str]], seed: int = 0) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sequences with the labels that their making gives them."""
    rng = random.Random(seed)
    refusals = [
        "I'm sorry, but I cannot answer this question.", "As a language model I am not able to solve this problem.",
        "Unfortunately, I have to decline this request.", "There is not enough information for me to attempt a solution.",
        "My rules do not allow me to provide an answer.", "I won't be able to help with the {t}.",
    ]
    polite = ["Please ask about something else.", "Is there anything else?", "You may want to check a textbook on the {t}.", "Thank you for the question.", "I hope you understand.", "Take care!"]
    foreign = [c for q, b, r in pairs if language(_plain(r)) not in (None, "en") for c in clauses(r)]
    seqs: list[np.ndarray] = []
    tags: list[np.ndarray] = []

    def add(parts: list[Clause], labels: list[int], q: Question, cut: bool = False) -> None:
        if parts:
            seqs.append(np.array(features(parts, q, cut)[0], dtype=float))
            tags.append(np.array(labels))

    def broken(parts: list[Clause], label: int, q: Question) -> None:
        """``parts`` of which the last breaks off somewhere."""
        last = parts[-1].whole()
        if len(last) > 12:
            text = "\n".join([*(p.whole() for p in parts[:-1]), last[: rng.randrange(6, len(last) - 3)]])
            got = clauses(text)
            if cut_reason(text) and len(got) == len(parts):
                add(got, [label] * (len(got) - 1) + [UNFINISHED], q, True)

    for question, background, response in pairs:
        q = Question(question, background)
        own = clauses(response)[:TRAIN_CLAUSES]
        asked = clauses(question)[:TRAIN_CLAUSES]
        if not own or not asked:
            continue
        same = language(_plain(response)) in (None, q.lang)
        rows = features(own, q, False)[0]
        good = same and bool(CONCLUDE.search(response)) and cut_reason(response) is None and not any(r[UNABLE] for r in rows)
        what = rng.randrange(7)
        if good and what in (0, 1):
            lead = asked if what == 1 else []
            add(lead + own, [ECHO] * len(lead) + [ECHO if r[ECHOES] else ANSWER for r in rows], q)
        elif what == 2:
            t = " ".join(_units(_plain(question))[3:5])
            parts = [c for x in [rng.choice(refusals), *rng.sample(polite, rng.randrange(3))] for c in clauses(x.format(t=t))]
            lead = asked if rng.random() < 0.3 else []
            talk = [c for c, r in zip(own, rows) if not (r[CONCLUDES] or r[UNABLE] or r[ECHOES])][:3] if rng.random() < 0.4 else []
            first = talk if rng.random() < 0.4 else []  # talk that answers nothing stands before or after
            after = [] if first else talk
            add(lead + first + parts + after, [ECHO] * len(lead) + [ANSWER] * len(first) + [REFUSAL] * len(parts) + [ANSWER] * len(after), q)
        elif what == 3:
            add(asked, [ECHO] * len(asked), q)
        elif what == 4 and foreign and q.lang == "en":
            parts = rng.sample(foreign, min(len(foreign), rng.randrange(2, 6)))
            add(parts, [FOREIGN] * len(parts), q)
        elif what == 5:
            broken(asked, ECHO, q)
        elif good:
            broken(own, ANSWER, q)
    return seqs, tags


def hand_set() -> Crf:
    """A starting point which states what each tag means, so that scarce samples do no harm."""
    crf = Crf(N_FEATURES, len(LABELS))
    crf.emit[UNABLE, REFUSAL] = crf.emit[REGRETS, REFUSAL] = 2
    crf.emit[POLITE, REFUSAL] = crf.emit[ECHOES, ECHO] = crf.emit[OTHER_LANG, FOREIGN] = crf.emit[14, UNFINISHED] = 3
    crf.emit[CONCLUDES, ANSWER] = crf.emit[NEW_MATH, ANSWER] = 2
    crf.emit[LABELS_IT, ECHO] = crf.emit[17, ECHO] = crf.emit[0, ANSWER] = 1
    return crf


def fit_tagger(pairs: list[tuple[str, str | None, str]]) -> Crf:
    seqs, tags = _training(pairs)
    crf = hand_set()
    return crf.fit(seqs, tags) if len(seqs) >= 20 else crf


class Tagged(NamedTuple):
    text: str
    cut: str | None
    parts: list[Clause]
    rows: list[tuple]
    units: list[str]


def prepared(text: str | None, q: Question) -> Tagged | None:
    """What is tagged and judged of a response; None if none of its clauses says anything."""
    if is_empty(text):
        return None
    parts = clauses(text)
    if all(is_empty(p.whole()) for p in parts[:8]) and all(is_empty(p.whole()) for p in parts):
        return None
    cut = cut_reason(text)
    return Tagged(text, cut, parts, *features(parts, q, cut is not None))


def by_coverage(got: Tagged, tags: list[int], q: Question) -> str | None:
    """The first defect that the tags give of refusal, copied, language, truncated; else None."""
    x = got.rows
    size = [p.size() for p in got.parts]
    cover = [0.0] * len(LABELS)
    for t, n in zip(tags, size):
        cover[t] += n / sum(size)
    answers = [i for i, t in enumerate(tags) if t == ANSWER]
    rest = 1 - cover[ECHO]
    refused = cover[REFUSAL] and cover[REFUSAL] >= 0.3 * rest or any(t == REFUSAL and x[i][UNABLE] for i, t in enumerate(tags))
    if refused and not any(ANSWERS.search(got.parts[i].whole()) and not x[i][REGRETS] for i in answers):
        return "refusal"
    # a label in front and single words say nothing
    said = any(x[i][CONCLUDES] or x[i][NEW_MATH] or x[i][OWN] and i for i in answers)
    if cover[ECHO] + cover[UNFINISHED] * (tags[-1] == UNFINISHED and x[-1][ECHOES]) >= 0.8 and not said:
        # a copy that breaks off within the question or after it is a cut response
        whole = len(q.asked - set(got.units)) <= 0.03 * len(q.asked) and echo_share(_units(_plain(got.parts[-1].whole())), q) >= 0.6
        if got.cut is None or whole:
            return "copied"
    # bare formulas and letters are in no language, so some foreign clause must show another one
    if cover[FOREIGN] > 0.5 and any(t == FOREIGN and x[i][OTHER_LANG] for i, t in enumerate(tags)):
        return "language"
    if tags[-1] == UNFINISHED and got.cut is not None:
        return "truncated"
    return None


def defects(responses: Iterable[tuple[str | None, Question]], crf: Crf) -> list[str | None]:
    """The first defect that fits of empty, refusal, copied, language, truncated for each response; else None."""
    got = [(prepared(t, q), q) for t, q in responses]
    rows = [r for g, _ in got if g for r in g.rows]
    tagged = iter(crf.tag_all(np.array(rows, dtype=float).reshape(len(rows), N_FEATURES), [len(g.parts) for g, _ in got if g]))
    return [by_coverage(g, next(tagged), q) if g else "empty" for g, q in got]


def questions_of(problems: DataFrame, external: DataFrame) -> DataFrame:
    """``problem_id``, ``question``, ``background``: one row per id of either table."""
    own = problems.select("problem_id", F.col("question_text").alias("question"), "background")
    other = external.select(F.col("item_id").alias("problem_id"), F.col("question_text").alias("question"), F.lit(None).cast("string").alias("background"))
    return own.unionByName(other).groupBy("problem_id").agg(F.max("question").alias("question"), F.max("background").alias("background"))


def with_questions(responses: DataFrame, questions: DataFrame, hot_share: float = 1 / 128) -> DataFrame:
    """``responses`` with the question of each, by broadcast for hot ids and by shuffle for the rest.

    At most 1/``hot_share`` ids can each hold that share of the rows, so what is
    broadcast is bounded whatever the data; a hot id's responses stay where they
    are. A response without a question keeps nulls.
    """
    n = responses.count()
    hot = responses.groupBy("problem_id").count().where(F.col("count") > max(1.0, n * hot_share)).select("problem_id")
    hot_ids = [r[0] for r in hot.collect() if r[0] is not None]
    few = questions.where(F.col("problem_id").isin(hot_ids)) if hot_ids else questions.limit(0)
    is_hot = F.coalesce(F.col("problem_id").isin(hot_ids), F.lit(False)) if hot_ids else F.lit(False)
    return (
        responses.where(is_hot).join(F.broadcast(few), "problem_id", "left")
        .unionByName(responses.where(~is_hot).join(questions, "problem_id", "left"))
    )


def mark_pairs(responses: DataFrame, questions: DataFrame, train_pairs: int = TRAIN_PAIRS) -> DataFrame:
    """``response_id``, ``defect`` (null: none), ``is_correct`` and ``rationale`` for every response.

    A null or blank response is ``empty``; one without a known question is
    judged without echo and language; repeated rows count each; an empty table
    gives no rows. Only the named columns are read.
    """
    rows = responses.select("response_id", "problem_id", "candidate", "is_correct", "rationale")
    sample = (
        rows.where("candidate is not null")
        .select("problem_id", "candidate", F.xxhash64("response_id").alias("h"))
        .orderBy("h")
        .limit(train_pairs)
        .join(questions, "problem_id")
        .orderBy("h")
        .select("question", "background", "candidate")
        .collect()
    )
    crf = fit_tagger([(r[0], r[1], r[2]) for r in sample if r[0]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, Question] = {}
        for b in batches:
            asked = []
            for key in zip(b["question"], b["background"]):
                if key not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[key] = Question(*key)
                asked.append(known[key])
            out = defects(zip(b["candidate"], asked), crf)
            yield pd.DataFrame({"response_id": b["response_id"], "defect": out, "is_correct": b["is_correct"], "rationale": b["rationale"]})

    return with_questions(rows, questions).mapInPandas(run, "response_id bigint, defect string, is_correct boolean, rationale string")
