"""Problem 3: markup residue in text.

``clean_markup`` finds markup of HTML, Markdown, a wiki or LaTeX text mode in a
text column and gives the text without it. Formulas between dollar signs, in
``\\(..\\)``, ``\\[..\\]`` or ``\\boxed{}`` are content and stay as they are.

Form of the clean text: a heading stands on a line of its own between blank
lines; list items start with ``- `` or ``1. ``; the cells of a table row are
joined by tabs; code lines are indented by four spaces. Text without markup is
left exactly as it was. Every HTML text becomes a tree, whose container is chosen
by scoring: paragraphs pass points for length and commas to their ancestors,
discounted by link density, and the best container and its like siblings stay;
of a fragment without link lists that is all of it. Trees are walked in one pass
over their events, so neither depth nor size of a page is a bar.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BRACED = r"\{(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*\}"
FORMULA = re.compile(
    r"\$\$.+?\$\$|\$(?:[^$\n]|\n(?!\n))+\$|\\\((?:.|\n)+?\\\)|\\\[(?:.|\n)+?\\\]|\\boxed\s*" + _BRACED
)
HALF_FORMULA = re.compile(r"(?:\$[^$\n]*|\\boxed\s*\{[^\n]*)$")

TAGS = (
    "a abbr article aside b big blockquote body br button caption center cite code col dd del details div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link "
    "main mark math meta nav nobr ol option p pre q s samp script section select small span strike strong style sub "
    "summary sup svg table tbody td textarea tfoot th thead title tr tt u ul var video wbr"
)
TAG = re.compile(
    r"</?(?:" + "|".join(TAGS.split()) + r")(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))?)*\s*/?>", re.I
)
#: an attribute without a value counts only beside one with a value, lest ``a <b and c> d`` be a tag
BARE_ATTR = re.compile(r"<[A-Za-z]\w*\s+[^=<>]*>$")
COMMENT = re.compile(r"<!--.*?-->|<!doctype[^<>]*>", re.I | re.S)
ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
TAIL_TAG = re.compile(r"</?(?:" + "|".join(x for x in TAGS.split() if len(x) > 1) + r")(?:\s+[\w-]+=[^<>]*)?$", re.I)

MD = {
    "heading": re.compile(r"^ {0,3}#{1,6}[ \t]+\S", re.M),
    "setext": re.compile(r"^[^\s|>#-][^\n]*\n(?:={3,}|-{3,})[ \t]*$", re.M),
    "strong": re.compile(r"\*\*(?=[^\s*])[^\n]*?[^\s*]\*\*|(?<!\w)__(?=[^\s_])[^\n_]*[^\s_]__(?!\w)"),
    "em": re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*?[^\s*]\*(?![\w*])|(?<![\w\\})\]])_(?=[^\s_{])[^_\n]*?[^\s_]_(?![\w{])"),
    "strike": re.compile(r"~~(?=\S)[^~\n]+~~"),
    "fence": re.compile(r"^ {0,3}(?:```|~~~)", re.M),
    "code": re.compile(r"(?<!`)`[^`\n]+`(?!`)"),
    "link": re.compile(r"!\[[^\]\n]*\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|\[[^\]\[\n]{2,}\]\([^()\s]*[./#][^()\s]*(?:\s+\"[^\"\n]*\")?\)"),
    "quote": re.compile(r"^ {0,3}>[ \t]+\S", re.M),
    "table": re.compile(r"^ {0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", re.M),
    "rule": re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M),
    "bullets": re.compile(r"^ {0,3}([*+])[ \t]+\S[^\n]*\n+ {0,3}\1[ \t]+\S", re.M),
}
WIKI = {
    "heading": re.compile(r"^(={2,6})[ \t]*[^=\n][^\n]*?\1[ \t]*$", re.M),
    "link": re.compile(r"\[\[(?![\s\d.,+\-\[\]]*[\]\[])[^\[\]\n]*[^\W\d_][^\[\]\n]*\]\]|\[https?://[^\]\s]+[^\]\n]*\]"),
    "template": re.compile(r"\{\{[A-Za-z!#:][^{}]*\}\}"),
    "quotes": re.compile(r"'''(?=\S)[^\n]+?'''|(?<!')''(?=[^'\s])[^'\n]+''(?!')"),
    "tag": re.compile(r"</?(?:nowiki|ref|gallery|includeonly|noinclude|onlyinclude|references|syntaxhighlight)\b[^<>]*>", re.I),
    "definition": re.compile(r"^;[^\n:]+:", re.M),
    "indent": re.compile(r"^:+[ \t]+\S[^\n]*(?:\n+:+[ \t]+\S|\Z)", re.M),
    "table": re.compile(r"^(?:\{\||\|\}|\|-)", re.M),
    "magic": re.compile(r"__(?:NO)?(?:TOC|EDITSECTION|INDEX)__|^#REDIRECT\b", re.M),
}
_TEXT_COMMANDS = (
    "section subsection subsubsection paragraph subparagraph chapter part title author date maketitle tableofcontents "
    "textbf textit texttt textsc textsf textsl textrm textup textmd textnormal emph underline uline item footnote footnotemark "
    "label ref eqref pageref autoref cref cite citep citet bibliography noindent indent newline linebreak newpage clearpage "
    "par hspace vspace hfill vfill smallskip medskip bigskip centering raggedright caption includegraphics usepackage "
    "documentclass url href verb qed large Large small footnotesize bfseries itshape ttfamily input include"
)
TEX = {
    "command": re.compile(r"\\(?:" + "|".join(_TEXT_COMMANDS.split()) + r")(?![A-Za-z])"),
    "environment": re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}"),
    "group": re.compile(r"\{\\(?:it|bf|em|tt|sc|sl|rm|sf|small|large|itshape|bfseries)\b"),
    "break": re.compile(r"\\\\[ \t]*(?:\[[^\]\n]*\])?[ \t]*(?:\n|$)"),
    "comment": re.compile(r"^%[^\n]*", re.M),
}


def _mask(text: str, kept: list[str] | None = None) -> tuple[str, list[str]]:
    """``text`` with its formulas as numbered marks, and the formulas, after those in ``kept``."""
    kept = [] if kept is None else kept
    if "$" not in text and "\\" not in text:
        return text, kept

    def take(m: re.Match[str]) -> str:
        kept.append(m[0])
        return f"\x02{len(kept) - 1}\x03"

    return HALF_FORMULA.sub(take, FORMULA.sub(take, text)), kept


def _tags(s: str) -> bool:
    return any(not BARE_ATTR.match(m[0]) for m in TAG.finditer(s))


def markup_kinds(text: str | None) -> list[str]:
    """The kinds of markup in ``text`` in alphabetical order; none for null."""
    if not text:
        return []
    return _kinds(_mask(text)[0])


def _kinds(s: str) -> list[str]:
    kinds: list[str] = []
    if ("<" in s and (_tags(s) or COMMENT.search(s) or TAIL_TAG.search(s, max(0, len(s) - 80)))) or ("&" in s and ENTITY.search(s)):
        kinds.append("html")
    if "\\" in s and any(TEX[k].search(s) for k in ("command", "environment", "group", "break")) or ("%" in s and TEX["comment"].search(s)):
        kinds.append("latex")
    star, under = "*" in s, "_" in s
    if (
        ("#" in s and MD["heading"].search(s))
        or (("===" in s or "---" in s) and (MD["setext"].search(s) or MD["table"].search(s) or MD["rule"].search(s)))
        or ("|" in s and "--" in s and MD["table"].search(s))
        or (star and (MD["strong"].search(s) or MD["em"].search(s) or MD["bullets"].search(s) or MD["rule"].search(s)))
        or (under and (MD["strong"].search(s) or MD["em"].search(s)))
        or ("~~" in s and (MD["strike"].search(s) or MD["fence"].search(s)))
        or ("`" in s and (MD["fence"].search(s) or MD["code"].search(s)))
        or ("](" in s and MD["link"].search(s))
        or (">" in s and MD["quote"].search(s))
        or ("\n+" in s and MD["bullets"].search(s))
    ):
        kinds.append("markdown")
    if (
        ("==" in s and WIKI["heading"].search(s))
        or (("[[" in s or "[http" in s) and WIKI["link"].search(s))
        or ("{{" in s and WIKI["template"].search(s))
        or ("''" in s and WIKI["quotes"].search(s))
        or ("<" in s and WIKI["tag"].search(s))
        or (";" in s and WIKI["definition"].search(s))
        or ((s.startswith(":") or "\n:" in s) and WIKI["indent"].search(s))
        or ("|" in s and ("{|" in s or "|}" in s or "|-" in s) and WIKI["table"].search(s) and not MD["table"].search(s))
        or (("__" in s or "#R" in s) and WIKI["magic"].search(s))
    ):
        kinds.append("wiki")
    return kinds


# ---------------------------------------------------------------- HTML tree
BLOCKS = {
    *"address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6".split(),
    *"header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split(),
}
VOID = {"br", "hr", "img", "input", "meta", "link", "col", "wbr"}
DROPPED = {"script", "style", "head", "nav", "iframe", "svg", "button", "select", "textarea", "form"}


class _Node:
    __slots__ = ("tag", "up", "start", "end", "head", "signs", "linked", "own", "commas", "score", "plain")

    def __init__(self, tag: str, up: _Node | None, start: int, head: bool) -> None:
        self.tag, self.up, self.start, self.end = tag, up, start, start
        self.head = head  # the first element of its parent
        self.signs = self.linked = self.own = self.commas = 0
        self.score = 0.0
        self.plain = ""  # its text up to what the rules for siblings look at

    @property
    def density(self) -> float:
        return self.linked / max(1, self.signs)


class _Tree(HTMLParser):
    """A page as a list of events (text, or a node at its start and end) in order, and its nodes, parents first."""

    #: an element that starts ends an open one of these kinds
    ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("root", None, 0, True)
        self.events: list[str | _Node] = [self.root]
        self.nodes = [self.root]
        self.opened: Counter[str] = Counter()
        self.with_kids: set[int] = set()

    def _close(self) -> None:
        self.at.end = len(self.events)
        self.events.append(self.at)
        self.opened[self.at.tag] -= 1
        if self.at.up is not None:
            self.at = self.at.up

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.at.tag in self.ENDS.get(tag, ()):
            self._close()
        node = _Node(tag, self.at, len(self.events), id(self.at) not in self.with_kids)
        self.with_kids.add(id(self.at))
        self.nodes.append(node)
        self.events.append(node)
        self.opened[tag] += 1
        self.at = node
        if tag in VOID:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if self.opened[tag] > 0:
            while self.at.tag != tag:
                self._close()
            self._close()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_data(self, data: str) -> None:
        self.events.append(data)
        n = self.at
        n.signs += len(data)
        n.own += len(data.strip())
        n.commas += data.count(",") + data.count("，")
        if len(n.plain) <= 400:
            n.plain += data[:400]

    def finish(self) -> None:
        self.close()
        while self.at is not self.root:
            self._close()
        self.root.end = len(self.events)
        self.events.append(self.root)
        for n in reversed(self.nodes):  # children before parents, so one pass adds all up
            if n.tag == "a":
                n.linked = n.signs
            up = n.up
            if up is not None:
                up.signs += n.signs
                up.linked += n.linked
                if len(up.plain) <= 400:
                    up.plain += n.plain
                if n.tag not in BLOCKS:
                    up.own += n.own
                    up.commas += n.commas


def _left_out(tree: _Tree) -> set[int]:
    """Numbers of the events at which parts start that do not belong to the main text.

    Paragraphs pass points for their length and commas to their parent, and half
    of them to its parent; the container with most points, less its share of
    text in links, is kept, and with it such siblings of it and of the nodes
    above it as have points of their own, say something outside links, or hold
    no links.
    """
    for n in tree.nodes:
        if n.tag in PARAGRAPHS and n.up is not None and n.own >= 25:
            points = 1 + n.commas + min(n.own // 100, 3)
            n.up.score += points
            if n.up.up is not None:
                n.up.up.score += points / 2
    best = max(tree.nodes, key=lambda n: n.score * (1 - n.density))
    top = best.score * (1 - best.density)
    if top <= 0:
        return set()
    above = {id(best)}
    at = best
    while at.up is not None:
        at = at.up
        above.add(id(at))
    out: set[int] = set()
    for k in tree.nodes:
        if k.up is None or id(k) in above or id(k.up) not in above or k.up is best:
            continue
        own, dense = k.plain.strip(), k.density
        like = k.score * (1 - dense) >= max(10.0, 0.2 * top) or dense < 0.25 and (len(own) > 80 or bool(SAYS.search(own))) or not dense and k.tag not in DROPPED
        if not like:
            out.add(k.start)
    return out


PARAGRAPHS = {"p", "td", "pre", "li", "blockquote", "div", "section"}
SAYS = re.compile(r"[.!?。]|\x03")
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
APART = HEADS | {"p", "div", "table", "ol", "ul", "blockquote", "section", "article"}


def _render(tree: _Tree) -> str:
    """The text of the main parts; lists, tables, headings and code keep their form."""
    left_out = _left_out(tree)
    out: list[str] = []
    lists: list[int | None] = []
    i = 0
    while i < len(tree.events):
        n = tree.events[i]
        if isinstance(n, str):
            out.append(n)
        elif i == n.end:  # after its kids
            if n.tag in ("ol", "ul"):
                lists.pop()
            if n.tag in APART:
                out.append("\n\n")
        elif n.tag in DROPPED or i in left_out:
            i = n.end
        elif n.tag == "pre":
            code = "".join(x for x in tree.events[i : n.end] if isinstance(x, str)).strip("\n")
            out.append("\n\n" + "\n".join("\x04" + x for x in code.split("\n")) + "\n\n")
            i = n.end
        elif n.tag in VOID:
            out.append({"br": "\n", "hr": "\n\n"}.get(n.tag, ""))
            i = n.end
        else:
            if n.tag in ("ol", "ul"):
                lists.append(0 if n.tag == "ol" else None)
            if n.tag in APART:
                out.append("\n\n")
            elif n.tag == "tr":
                out.append("\n")
            elif n.tag == "li":
                if lists and lists[-1] is not None:
                    lists[-1] += 1
                    out.append(f"\n{lists[-1]}. ")
                else:
                    out.append("\n- ")
            elif n.tag in ("td", "th") and not n.head:
                out.append("\t")
        i += 1
    return "".join(out)


def _page(s: str) -> _Tree:
    """The tree of ``s``, in which a sign that opens no known tag is text."""
    t = _Tree()
    t.feed(COMMENT.sub("", NO_TAG.sub("&lt;", s) if "<" in s else s))
    t.finish()
    return t


def _from_html(s: str) -> str:
    return html.unescape(_render(_page(s))).replace("\xa0", " ")


NO_TAG = re.compile(r"<(?!/?(?:" + "|".join(TAGS.split()) + r")\b[^<>]*>|!--)", re.I)


# ------------------------------------------------------- line based formats
def _code_line(x: str) -> str:
    return "\x04" + x


WRAP = re.compile(
    r"(\\(?:textbf|textit|texttt|textsc|textsf|textsl|textrm|textup|textmd|textnormal|emph|underline|uline|url|verb|caption|title|author|date|text)\{"
    r"|\{\\(?:it|bf|em|tt|sc|sl|rm|sf|small|large|itshape|bfseries)\b\s*)|([{}])"
)


def _unwrap(s: str) -> str:
    """``s`` without commands and groups that only dress their text, however deep they nest; what is never closed stays."""
    out: list[str] = []
    opened: list[tuple[int, bool]] = []
    at = 0
    for m in WRAP.finditer(s):
        out.append(s[at : m.start()])
        at = m.end()
        if m[1] or m[2] == "{":
            opened.append((len(out), bool(m[1])))
            out.append(m[0])
        elif opened:
            place, dress = opened.pop()
            if dress:
                out[place] = ""
            else:
                out.append("}")
        else:
            out.append("}")
    return "".join(out) + s[at:]


NAMED, BRACE, TRAIL = re.compile(r"[A-Za-z!#:]"), re.compile(r"[{}]"), re.compile(r"[ \t]*\n?")


def _without_templates(s: str) -> str:
    """``s`` without ``{{..}}`` that start with a name, whatever stands in them."""
    opened: list[int] = []
    gone: list[tuple[int, int]] = []
    for m in re.finditer(r"\{\{|\}\}", s):
        if m[0] == "{{":
            opened.append(m.start())
        elif opened:
            a = at = opened.pop()
            at += 2
            bare = bool(NAMED.match(s, at))
            first = len(gone)
            while first and gone[first - 1][0] > a:
                first -= 1
            for x, y in gone[first:]:
                bare = bare and not BRACE.search(s, at, x)
                at = y
            if bare and not BRACE.search(s, at, m.start()):
                gone[first:] = [(a, TRAIL.match(s, m.end()).end())]
    out, at = [], 0
    for a, b in gone:
        out.append(s[at:a])
        at = b
    return "".join(out) + s[at:]


def _from_latex(s: str) -> str:
    def verbatim(m: re.Match[str]) -> str:
        return "\n\n" + "\n".join(_code_line(x) for x in m[2].strip("\n").split("\n")) + "\n\n"

    s = re.sub(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\{\w+\})?(.*?)(?:\\end\{\1\*?\}|\Z)", verbatim, s, flags=re.S)
    s = TEX["comment"].sub("", s)
    s = re.sub(r"\\(?:chapter|part|section|subsection|subsubsection)\*?\{([^{}]*)\}", r"\n\n\1\n\n", s)
    s = re.sub(r"\\(?:paragraph|subparagraph)\*?\{([^{}]*)\}", r"\n\n\1: ", s)
    s = re.sub(r"\\begin\{(?:align|equation|gather|multline|displaymath|eqnarray)\*?\}(.*?)(?:\\end\{[A-Za-z]+\*?\}|\Z)", lambda m: "\n\n" + "\n".join(f"${re.sub(r'\\label\{[^{}]*\}', '', x).strip()}$" for x in m[1].split("\\\\") if x.strip()) + "\n\n", s, flags=re.S)
    kind: list[list] = []
    out: list[str] = []
    at = 0
    for m in re.finditer(r"\\begin\{([A-Za-z]+\*?)\}(?:\[[^\]]*\]|\{[^{}]*\})*|\\end\{([A-Za-z]+\*?)\}|\\item\s*(?:\[([^\]]*)\])?\s*", s):
        out.append(s[at : m.start()])
        at = m.end()
        if m[1]:
            kind.append([m[1].rstrip("*"), 0])
            out.append("\n\n")
        elif m[2]:
            if kind:
                kind.pop()
            out.append("\n\n")
        elif m[3] is not None:
            out.append(f"\n{m[3].strip()} " if re.fullmatch(r"\W*\w{1,3}[.)]?", m[3].strip()) else f"\n- {m[3].strip()} ")
        elif kind and kind[-1][0] == "enumerate":
            kind[-1][1] += 1
            out.append(f"\n{kind[-1][1]}. ")
        else:
            out.append("\n- ")
    out.append(s[at:])
    s = "".join(out)
    s = _unwrap(s)
    s = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", s)
    s = re.sub(r"[ ~]*\\(?:label|cite|citep|citet|bibliography|includegraphics|vspace|hspace|usepackage|documentclass|input|include)\*?(?:\[[^\]]*\])?\{[^{}]*\}?", "", s)
    s = re.sub(r"~?\\(?:ref|eqref|pageref|autoref|cref)\{([^{}]*)\}", r" \1", s)
    s = re.sub(r"\\\\[ \t]*(?:\[[^\]\n]*\])?[ \t]*(?:\n|$)", "\n", s)
    s = re.sub(r"\\(?:noindent|indent|newline|linebreak|newpage|clearpage|par|hfill|vfill|smallskip|medskip|bigskip|centering|raggedright|maketitle|tableofcontents|qed|footnotemark|large|Large|small|footnotesize|bfseries|itshape|ttfamily|item)(?![A-Za-z])\s?", "", s)
    s = re.sub(r"\\(?:section|subsection|subsubsection|paragraph|textbf|textit|emph|underline|texttt|footnote)\*?\{?", "", s)
    return re.sub(r"(?<=\w)~(?=[\w\x02])", " ", re.sub(r"\\([%&#_])", r"\1", s))


def _from_wiki(s: str) -> str:
    s = re.sub(r"<nowiki>(.*?)</nowiki>", r"\1", s, flags=re.S | re.I)
    s = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>(.*?)</ref>", lambda m: f" ({m[1].strip()})" if m[1] else "", s, flags=re.S | re.I)
    s = _without_templates(s)
    s = re.sub(r"\[\[(?:File|Image|Category|Datei|Bild|Fichier|Archivo)\s*:[^\[\]]*\]\][ \t]*\n?", "", s, flags=re.I)
    s = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*[^\W\d_][^\[\]|\n]*)\]\]", r"\1", s)
    s = re.sub(r"\[https?://[^\]\s]+\s*([^\]\n]*)\]", r"\1", s)
    s = re.sub(r"'''(?=\S)([^\n]+?)'''", r"\1", s)
    s = re.sub(r"(?<!')''(?=[^'\s])([^'\n]+)''(?!')", r"\1", s)
    s = re.sub(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", r"\n\n\2\n\n", s, flags=re.M)
    s = re.sub(r"__(?:NO)?(?:TOC|EDITSECTION|INDEX)__|^#REDIRECT\b", "", s, flags=re.M)
    out: list[str] = []
    cells: list[str] | None = None
    for line in s.split("\n"):
        if line.startswith("{|"):
            cells = []
            out.append("")
        elif cells is not None and line.startswith(("|-", "|}")):
            if cells:
                out.append("\t".join(cells))
            cells = [] if line.startswith("|-") else None
        elif cells is not None and line.startswith(("|", "!")):
            cells += [x.strip() for x in re.split(r"\|\||!!", line[1:])]
        else:
            m = re.match(r"^;[ \t]*([^\n:]+?)[ \t]*:[ \t]*(.*)$", line)
            if m:
                line = f"{m[1]}: {m[2]}"
            elif re.match(r"^:+[ \t]+\S", line):
                line = re.sub(r"^:+[ \t]+", "", line)
            elif re.match(r"^\*+[ \t]*\S", line):
                line = re.sub(r"^\*+[ \t]*", "- ", line)
            out.append(line)
    if cells:
        out.append("\t".join(cells))
    return "\n".join(out)


def _from_markdown(s: str) -> str:
    out: list[str] = []
    fence = ""
    lines = s.split("\n")
    for i, line in enumerate(lines):
        m = re.match(r"^ {0,3}(```+|~~~+)", line)
        if m and (not fence or line.strip().startswith(fence)):
            fence = "" if fence else m[1]
            out.append("")
            continue
        if fence:
            out.append(_code_line(line))
            continue
        if MD["table"].match(line):
            continue
        if i and re.fullmatch(r"(={3,}|-{3,})[ \t]*", line) and lines[i - 1].strip():
            out[-1:] = ["", out[-1], ""]
            continue
        if MD["rule"].match(line):
            out.append("")
            continue
        line = re.sub(r"^ {0,3}>[ \t]?", "", line)
        h = re.match(r"^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*$", line)
        if h:
            out += ["", h[1], ""]
            continue
        if re.match(r"^ {0,3}\|.*", line) and "|" in line[1:]:
            line = "\t".join(x.strip() for x in line.strip().strip("|").split("|"))
        line = re.sub(r"^([ \t]*)[*+-][ \t]+(?=\S)", r"\1- ", line)
        out.append(line)
    s = "\n".join(out)
    s = re.sub(r"!\[([^\]\n]*)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)", r"\1", s)
    s = re.sub(r"\[([^\]\[\n]{2,})\]\([^()\s]*[./#][^()\s]*(?:\s+\"[^\"\n]*\")?\)", r"\1", s)

    def plain(line: str) -> str:
        if line.startswith("\x04"):
            return line
        line = re.sub(r"\*\*(?=[^\s*])([^\n]*?[^\s*])\*\*", r"\1", line)
        line = re.sub(r"(?<!\w)__(?=[^\s_])([^\n_]*[^\s_])__(?!\w)", r"\1", line)
        line = re.sub(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])", r"\1", line)
        line = re.sub(r"(?<![\w\\})\]])_(?=[^\s_{])([^_\n]*?[^\s_])_(?![\w{])", r"\1", line)
        line = re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", line)
        return re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", line)

    return "\n".join(plain(x) for x in s.split("\n"))


CONVERT: dict[str, Callable[[str], str]] = {"html": _from_html, "latex": _from_latex, "wiki": _from_wiki, "markdown": _from_markdown}


#: Signs that mark formulas and code lines while a text is converted; a text's own are dropped then.
_OWN_SIGNS = {2: None, 3: None, 4: None}


def clean_text(text: str | None) -> tuple[str | None, list[str]]:
    """The clean text and the kinds of markup found; null stays null, unmarked text stays as it is."""
    if not text:
        return text, []
    s, formulas = _mask(text.translate(_OWN_SIGNS))
    kinds = _kinds(s)
    if not kinds:
        return text, []
    found: set[str] = set(kinds)
    seen: set[int] = set()
    while (now := _kinds(s)) and hash(s) not in seen:  # one kind may wrap another
        seen.add(hash(s))
        found.update(now)
        for k in ("latex", "html", "wiki", "markdown"):
            if k in now:
                s = CONVERT[k](s)
                if k == "latex":  # display formulas stand between dollar signs now
                    s, formulas = _mask(s, formulas)
        s = re.sub(r"[ \t]+\n", "\n", s)
    s = re.sub(r"\n{3,}", "\n\n", s)
    s = "\n".join(("    " + x[1:]) if x.startswith("\x04") else re.sub(r" {2,}", " ", x).rstrip() for x in s.split("\n")).strip("\n").rstrip()
    while "\x02" in s:  # a formula may hold earlier ones
        before, s = s, re.sub(r"\x02(\d+)\x03", lambda m: formulas[int(m[1])] if int(m[1]) < len(formulas) else "", s)
        if s == before:
            break
    return s, sorted(found)


def clean_markup(df: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """``key_cols``, ``clean_text``, ``kinds`` and ``has_markup`` for every row.

    Null text gives null clean text and no kinds, empty text an empty one; very
    long texts are read whole; repeated rows count each; only the named columns
    are read, so extra columns cannot clash. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [clean_text(x) for x in b["text_in"]]
            out = b.drop(columns="text_in")
            out["clean_text"] = [x for x, _ in got]
            out["kinds"] = [x for _, x in got]
            yield out

    rows = df.select(*key_cols, F.col(text_col).alias("text_in"))
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key_cols)
    done = rows.mapInPandas(run, f"{keys}, clean_text string, kinds array<string>")
    return done.withColumn("has_markup", F.size("kinds") > 0)
