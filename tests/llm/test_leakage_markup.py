"""Problems 2 and 3."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("benchsieve.llm")

from pyspark.sql import functions as F

from benchsieve.llm import leakage, markup
from benchsieve.llm.words import ShingleIndex

ITEM = (
    "Consider a noisy rate region that serves a linear field sample through a weighted feedback channel with $\\alpha_{k}$ held at 5.1 km. "
    "Suppose 56 copies of the imperfect equalizer compete for the coherent payload, each weighted by $\\eta_{1}$. Find the largest throughput for which the cooperative interval vanishes."
)
FILL = "The authors measured the covert channel at 12 users near an error floor. A common mistake is to treat the virtual delay as a differential outage event. "


def found(spark, docs, items=(("i", ITEM),)):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    return {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, spark.createDataFrame(list(items), "item_id string, item_text string")).collect()}


def test_leaks(spark):
    words = ITEM.split()
    noisy = list(words)
    for i in range(4, len(noisy), 11):
        noisy[i] = "other"
    part = " ".join(words[17:45])
    docs = [
        FILL + ITEM + FILL, ITEM.upper().replace("$\\ALPHA_{K}$", "\\(\\alpha_k\\)"), FILL + " ".join(noisy), FILL * 20 + part + FILL * 20, FILL + " ".join(words[:25]) + " (as we saw in the second lecture of the course) " + " ".join(words[25:]),
        FILL * 30, " ".join(words[:11]), None, "", "x" * 100_000, FILL + "**" + "** **".join(words) + "**", "<p>" + "</p>\n<p>".join(words) + "</p>",
        "Consider a stale base station that serves a passive outage event through a hybrid decoder, with $x$ held at 9 dB. Suppose 3 copies of the bursty relay compete for the sparse queue, each weighted by $y$.",
    ]
    assert found(spark, docs) == {(i, "i") for i in (0, 1, 2, 3, 4, 10, 11)}


def test_leaks_edges(spark):
    assert found(spark, []) == set()
    assert found(spark, [ITEM], [("n", None), ("e", ""), ("s", "short text")]) == set()
    many = [(f"i{k}", ITEM) for k in range(150)]  # more copies than a window may have and still count as rare
    assert found(spark, [FILL + ITEM], many) == {(0, k) for k, _ in many}
    near = [(f"i{k}", ITEM.replace("56", str(k)).replace("imperfect", f"imperfect{k}")) for k in range(150)]
    assert found(spark, [FILL + ITEM.replace("imperfect", "imperfect7")], near) == {(0, k) for k, _ in near}
    rep = leakage.leak_report(spark.createDataFrame([("i", ITEM), ("j", "none")], "item_id string, item_text string"), spark.createDataFrame([(1, "i", 4, "passage"), (2, "i", 5, "reparameterised")], "doc_id bigint, item_id string, windows int, kind string"))
    assert {tuple(r) for r in rep.collect()} == {("i", 9, 2, 1, False), ("j", 0, 0, 0, True)}


def kinds(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in leakage.find_shared(d, spark.createDataFrame(items, "item_id string, item_text string")).collect()}


def test_slots_must_be_consistent(spark):
    """A question with other values is found if each value stands for one other; values dealt at random leave a template."""
    item = (
        "Suppose 56 copies of the noisy equalizer with gain $g_1$ compete for the coherent payload of 12 bits, so that 56 copies need 12 bits and gain $g_1$ whenever the 31 relays hold $h_2$. "
        "Find the largest throughput for which 31 relays with gain $g_1$ and level $h_2$ serve 56 copies of the cooperative interval at 12 bits."
    )
    values = ["56", "12", "31", "$g_1$", "$h_2$"]
    other = dict(zip(values, ["83", "47", "95", "$q_7$", "$u_5$"]))
    pattern = re.compile("|".join(map(re.escape, values)))
    same = pattern.sub(lambda m: other[m[0]], item)
    rng = random.Random(1)
    mixed = pattern.sub(lambda m: f"$z_{{{rng.randrange(1000)}}}$" if "$" in m[0] else str(rng.randrange(100, 1000)), item)
    got = kinds(spark, [FILL + item + FILL, FILL + same + FILL, FILL + mixed + FILL], [("i", item)])
    assert got == {(0, "i"): "passage", (1, "i"): "reparameterised", (2, "i"): "template"}


def test_contradictions():
    bad = leakage.contradictions(np.array([1, 1, 2, 3, 1]), np.array([7, 7, 7, 3, 8]))
    assert bad.tolist() == [False, False, True, False, True]


def test_large_families_lose_no_item(spark):
    """Items that all are near-copies of each other; each passage belongs to all of them."""
    for n in (50, 200, 1000):
        items = [(f"i{k}", ITEM.replace("imperfect", f"imperfect{k}q")) for k in range(n)]
        assert found(spark, [FILL * 2 + ITEM + FILL], items) == {(0, k) for k, _ in items}


def test_windows_of_very_many_items_come_in_parts():
    index = ShingleIndex([str(k) for k in range(40)], [ITEM] * 40, slots=True)
    ids = index.reader().read(ITEM + " " + ITEM)
    whole = index.hits(ids)
    rows = sorted(zip(*(x.tolist() for x in whole[:3])))
    parts = list(index.hits_in_parts(ids, 300))
    assert len(parts) > 2 and sorted(r for p in parts for r in zip(*(x.tolist() for x in p[:3]))) == rows
    assert all(set(a[0]).isdisjoint(b[0]) for i, a in enumerate(parts) for b in parts[:i])


def of_one_template(rng, n):
    """Texts of the same fixed words with other words in between, some of which meet again."""
    fixed = ["suppose copies of", "compete for the coherent payload while", "uses step size", "under the given constraint of", "determine largest throughput for", "vanishes"]
    return [" ".join(f"{f} the {rng.choice(LETTERS)}{rng.choice(LETTERS)}ish {rng.choice(LETTERS)}{rng.choice(LETTERS)}ness" for f in fixed) for _ in range(n)]


LETTERS = ["ba", "co", "du", "fe", "gi", "ho", "ka", "lu", "me", "ni", "po", "ra"]


def scanned(texts, items, sift=True):
    """Rows of shared windows, rows that are put in order, and the passages found."""
    index = ShingleIndex([[f"i{k}"] for k in range(len(items))], items, slots=True)
    met, ordered, rows_in_parts, runs = [], [], index.rows_in_parts, leakage._runs
    index.rows_in_parts = lambda ids: (met.append(len(p[0])) or p for p in rows_in_parts(ids))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(leakage, "_runs", lambda got, doc, text, *rest: ordered.append(len(text)) or runs(got, doc, text, *rest))
        if not sift:
            m.setattr(leakage, "promising", lambda got, doc, r, *rest: np.arange(len(r)))
            m.setattr(leakage, "alignable", lambda *rest: True)
        got = sorted((d, *map(str, p)) for d, p in leakage.passages(texts, index.reader(), index, 20, 0.86))
    return sum(met), sum(ordered), got


def test_windows_of_a_template_are_sifted_before_they_are_put_in_order():
    """A document that has but the stock words of very many items costs little, and what is found is the same."""
    rng = random.Random(3)
    items = of_one_template(rng, 3000)
    stock = "Here uses step size once more. "
    texts = [FILL * 2 + stock + FILL * 2, FILL + items[7] + FILL, stock + FILL * 4 + stock, FILL + items[11].replace("throughput", "delay") + FILL]
    met, ordered, got = scanned([texts[0], texts[2]], items)
    assert got == [] and met >= 9000 and ordered < met / 5
    _, _, got = scanned(texts, items)
    assert {g[0] for g in got} == {1, 3} and got == scanned(texts, items, sift=False)[2]


def test_sifting_loses_no_passage(monkeypatch):
    """Noisy copies of items of a template, in parts of any size: as without a sift."""
    rng = random.Random(8)
    items = of_one_template(rng, 300)
    texts = []
    for k in range(60):
        words = items[k].split()
        for _ in range(rng.randrange(9)):
            p = rng.randrange(len(words))
            words[p : p + rng.randrange(2)] = rng.choice([[], ["other"], ["also", "other"], rng.sample(words, 1)])
        texts.append(FILL * rng.randrange(2) + " ".join(words) + ". " + FILL + " ".join(rng.choice(items).split()[: rng.randrange(30)]))
    want = scanned(texts, items, sift=False)[2]
    assert len(want) > 40
    for most in (1_000_000, 700, 20):
        monkeypatch.setattr(leakage, "SIFTED", most)
        assert scanned(texts, items)[2] == want


def test_spans_are_those_of_best_span():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 30, 200)
    head = np.cumsum(size) - size
    hit = rng.random(int(size.sum())) < 0.8
    i, j = leakage.spans(hit, head, size, 86)
    for a, n, x, y in zip(head, size, i, j):
        p, q = leakage.best_span(hit[a : a + n], 0.86)
        assert q - p == y - x and hit[a + x : a + y].sum() >= 0.86 * (y - x) - 1e-9


def test_long_remark_and_repeated_item(spark):
    words = ITEM.split()
    remark = "(" + " ".join(f"remark{i}" for i in range(30)) + ")"
    docs = [FILL + " ".join(words[:18]) + " " + remark + " " + " ".join(words[18:36]) + ". " + FILL, (" ".join(words[:9]) + " ") * 30 + FILL * 3 + ITEM + " " + (" ".join(words[:9]) + " ") * 30]
    assert found(spark, docs) == {(0, "i"), (1, "i")}


def test_differing_content_words(spark):
    """One word in eight differs, and all of these are content words."""
    words = ITEM.split()[:21]  # the last is the unit of a number
    for a, b in (("noisy", "linear"), ("serves", "weighted"), ("region", "sample"), ("field", "channel")):
        part = " ".join({a: "lossy", b: "stale"}.get(w, w) for w in words)
        assert found(spark, [FILL * 3 + part + ". " + FILL * 3]) == {(0, "i")}, (a, b)
    assert found(spark, [FILL + ITEM.replace("noisy rate region", "stale base station").replace("linear field sample", "passive outage event")[:150]]) == set()


def test_stretch_shared_by_many_items(spark):
    """The passage lies where over 64 items agree, the rest of each is its own."""
    part = " ".join(ITEM.split()[:26])
    rare = lambda k: " ".join(f"own{'abcdefghij'[j]}word{k}x the" for j in range(10))
    items = [(f"i{k}", f"{part}. {rare(k)}.") for k in range(100)]
    doc = part.replace("noisy", "lossy").replace("weighted", "stale")
    assert found(spark, [FILL * 3 + doc + ". " + FILL * 3], items) == {(0, k) for k, _ in items}


def test_best_span():
    rng = np.random.default_rng(0)
    for _ in range(300):
        h = rng.random(rng.integers(1, 22)) < rng.random()
        share = rng.choice([0.5, 0.75, 0.86])
        want = max(j - i for i in range(len(h) + 1) for j in range(i, len(h) + 1) if h[i:j].sum() >= share * (j - i) - 1e-9)
        i, j = leakage.best_span(h, share)
        assert j - i == want


def test_blocks_give_the_same(spark):
    from benchsieve.llm.overlap import query_blocks

    q = spark.createDataFrame([(str(i), "w" * 50) for i in range(40)], "k string, t string")
    blocks = list(query_blocks(q, 500))
    assert len(blocks) > 2 and sorted(r[0] for b, _ in blocks for r in b) == sorted(str(i) for i in range(40))
    assert [last for _, last in blocks] == [False] * (len(blocks) - 1) + [True]


PLAIN = [
    "Here 3 * 3 < 5 * 32, so a < b holds.", "User #60 sees 2 * 62 copies.", "The matrix is [[1, 0], [0, 8]] when n > 23.", "The set {1, ..., 4} is used & kept for x_16.", "Since rank(H) == 3 and N < 40, this is tight.",
    "We get $\\mathbf{x} \\text{ if } a < b$ and \\boxed{\\frac{a}{b}}.", "A line\n\nAnother line.", "It costs 5% of a*b*c and f_i(x_j).", "Let x' and y'' be given.", "", "a <b and c> d", "Step 1. Then 2.\nFinal answer: D", "1. one\n2. two", "so that \\hat{x}_{k}+\\mathbf{h}_{m} holds, with ω_2 and (a)_(b)_ fixed",
]
MARKED = [
    ("<p>One, two.</p><p>Three.</p>", "html", "One, two.\n\nThree."), ("a &amp; b &#8212; c", "html", "a & b — c"), ("<ol><li>a</li><li>b</li></ol>", "html", "1. a\n2. b"), ("<table><tr><th>s</th><th>r</th></tr><tr><td>1</td><td>$x<y$</td></tr></table>", "html", "s\tr\n1\t$x<y$"),
    ("<pre><code>if a &lt; b:\n    stop()</code></pre>", "html", "    if a < b:\n        stop()"), ("x<br/>\ny", "html", "x\n\ny"), ("# Head\n\ntext **bold** and `code`", "markdown", "Head\n\ntext bold and code"), ("Solution\n--------\n\nx", "markdown", "Solution\n\nx"),
    ("| a | b |\n|---|---|\n| 1 | $x$ |", "markdown", "a\tb\n1\t$x$"), ("> quoted\n> more", "markdown", "quoted\nmore"), ("```python\nx = 1\n```\nend", "markdown", "    x = 1\n\nend"), ("see ![s](img/1.png) and [n](notes/a.md)", "markdown", None), ("~~gone~~ and _this one_", "markdown", "gone and this one"),
    ("== Head ==\n* one\n* two", "wiki", "Head\n\n- one\n- two"), ("'''Result''' for [[Channel|the channel]]", "wiki", "Result for the channel"), ("{{Infobox|title=x}}\ntext", "wiki", "text"), ("; gain : high\n: more", "wiki", "gain: high\nmore"),
    ("\\section{Head}\ntext", "latex", "Head\n\ntext"), ("\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}", "latex", "- one\n\n- two"), ("\\textbf{Step \\emph{1}.} go\\footnote{note}", "latex", "Step 1. go (note)"), ("% source\n\\noindent text.\\\\\nmore", "latex", "text.\nmore"),
    ("\\begin{align}\na \\\\ b\n\\end{align}", "latex", "$a$\n$b$"),
]


@pytest.mark.parametrize("t", PLAIN)
def test_unmarked_text_stays(t):
    assert markup.clean_text(t) == (t, [])


@pytest.mark.parametrize("t,kind,want", MARKED)
def test_marked_text(t, kind, want):
    clean, kinds = markup.clean_text(t)
    assert kind in kinds
    assert want is None or clean == want
    assert markup.markup_kinds(clean) == []


def test_tree_scoring_leaves_out_link_lists():
    links = "".join(f'<li><a href="u{i}">link number {i}</a></li>' for i in range(20))
    body = "".join(f"<p>The channel, which is flat, has gain {i}, and so the rate, as shown above, stays bounded by it.</p>" for i in range(4))
    clean, _ = markup.clean_text(f"<html><body><div id=n><ul>{links}</ul></div><div id=m><h2>Rates</h2>{body}</div></body></html>")
    assert "Rates" in clean and "gain 3" in clean and "link number" not in clean


def test_scoring_keeps_containers_like_the_best():
    say = "<p>The channel, which is flat, has gain {}, and so the rate, as shown above, stays bounded by it.</p>"
    nav = '<div><a href="x">home</a> <a href="y">all papers of this group</a> <a href="z">contact, terms</a></div>'
    page = f"<body>{nav}<div>{say.format(1) * 3}</div><div>{say.format(2) * 2}</div><div>Short note.</div>{nav}</body>"
    clean, kinds = markup.clean_text(page)
    assert kinds == ["html"] and "gain 1" in clean and "gain 2" in clean and "Short note." in clean and "home" not in clean


@pytest.mark.parametrize(
    "text,want",
    [
        ("<div>" * 100_000 + "x" + "</div>" * 100_000, "x"), ("<b><i>" * 50_000 + "x", "x"), ("<div>" * 50_000 + "x" + "</p>" * 50_000, "x"), ("\\textbf{" * 20_000 + "x" + "}" * 20_000, "x"), ("a {{b|" + "{{c|" * 20_000 + "}}" * 20_000 + "}} d", "a d"),
        ("{\\it a \\textbf{b} {c} $d$}", "a b {c} $d$"),
    ],
)
def test_depth_is_no_bar(text, want):
    assert markup.clean_text(text)[0] == want


def test_large_page():
    page = "<html><body>" + "<p>Some words, and a <a href=x>link</a> too.</p>" * 220_000 + "</body></html>"
    assert len(page) > 10_000_000
    clean, kinds = markup.clean_text(page)
    assert kinds == ["html"] and clean.count("Some words, and a link too.") == 220_000


def test_signs_used_for_marking_do_no_harm():
    assert markup.clean_text("<b>a</b> \x020\x03 $x$")[0] == "a 0 $x$"
    assert markup.clean_text("a \x020\x03") == ("a \x020\x03", [])


def test_operator(spark):
    rows = [(1, None), (2, ""), (3, "<b>x</b>"), (3, "<b>x</b>"), (4, "plain " * 40_000)]
    df = spark.createDataFrame(rows, "k bigint, v string").withColumn("kinds", F.lit(0)).withColumn("clean_text", F.lit("clash"))
    got = sorted((r["k"], r["has_markup"], r["clean_text"]) for r in markup.clean_markup(df, ["k"], "v").collect() if r["k"] != 4)
    assert [g[:2] for g in got] == [(1, False), (2, False), (3, True), (3, True)]
    assert markup.clean_markup(df.limit(0), ["k"], "v").count() == 0


def test_random_text_never_fails():
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<b", "&amp;", "$", "\\boxed{", "}", "**", "_", "`", "```\n", "\n", "== ", " ==", "[[", "]]", "{{a", "}}", "\\begin{itemize}", "\\item ", "\\end{align}", "%", "|", "|---|---|", "word ", "# ", "> ", "''", "é", "中文", "<pre>", "<table><tr><td>"]
    for _ in range(1500):
        markup.clean_text("".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))))
