"""Problem 9: cutting oversized texts at natural boundaries.

Agglomerative merging: a text starts as atomic segments (lines and sentences;
words or tokens where a sentence is too long by itself), the boundaries between
neighbours wait in a heap, and the weakest is merged first as long as the two
sides and the overlap fit the limit. What is left are pieces cut at the
strongest boundaries.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from benchsieve.llm.tokens import TOKENIZER, encoder

LIMIT = 512
OVERLAP = 64
#: Kinds of boundaries from weak to strong.
KINDS = ["token", "word", "clause", "sentence", "line", "paragraph", "heading"]
TOKEN, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH, HEADING = range(7)
COARSE = re.compile(r"\n[ \t]*\n\s*|\n[ \t]*|(?<=[.!?;])[\"')\]]*(?=\s)|[。！？；]")
FINE = re.compile(r"(?<=[,:)])(?=\s)|[，、：]|(?=\s)")
HEAD = re.compile(r"#{1,6}\s|={2,}\s*\S|\\(?:sub)*section|\\chapter|<h[1-6]\b|\*\*[^*\n]+\*\*\s*$", re.M)


def _marks(text: str, rx: re.Pattern[str], lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    """Places where a cut may be made, and the kind of each."""
    out = []
    for m in rx.finditer(text, lo, len(text) if hi is None else hi):
        got = m[0]
        at = m.end()
        if "\n" in got:
            kind = HEADING if HEAD.match(text, at) else PARAGRAPH if got.count("\n") > 1 else LINE
        elif rx is COARSE:
            kind = SENTENCE
        else:
            kind = CLAUSE if got or text[at - 1 : at] in ",:)" else WORD
        out.append((at, kind))
    return out


def cut(text: str, enc, sizes: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int, str]]:
    """Pieces of ``text`` as (char_start, char_end, token_start, n_tokens, overlap, boundary); none if it fits ``limit``.

    Tokens are those of the whole text, so neighbours share exactly ``overlap``
    of them (up to three fewer where a character of several tokens would be
    cut). Every token outside the overlaps is in exactly one piece.
    """
    ids = np.array(enc.encode_ordinary(text), dtype=np.int64)
    n = len(ids)
    if n <= limit:
        return []
    ends = np.cumsum(sizes[ids])
    starts = np.concatenate(([0], ends))  # byte place of each token, and the end
    if ends[-1] == len(text):
        chars = starts
        whole = np.ones(n + 1, dtype=bool)
    else:
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        lead = (raw & 0xC0) != 0x80
        before = np.concatenate(([0], np.cumsum(lead)))
        chars = before[starts]
        whole = np.concatenate((lead[starts[:-1]], [True]))  # a token that starts inside a character is no place to cut
    room = limit - overlap
    kinds = np.full(n + 1, -1, dtype=np.int8)

    def place(marks: list[tuple[int, int]]) -> None:
        if not marks:
            return
        at = np.searchsorted(chars, [p for p, _ in marks])
        for t, (_, k) in zip(at.tolist(), marks):
            while t < n and not whole[t]:
                t += 1
            if 0 < t < n and kinds[t] < k:
                kinds[t] = k

    place(_marks(text, COARSE))
    edges = [0, *np.flatnonzero(kinds[1:n] >= 0) + 1, n]
    for a, b in zip(edges, edges[1:]):
        if b - a > room:  # a sentence that is too long by itself
            place(_marks(text, FINE, int(chars[a]), int(chars[b])))
            inner = [a, *np.flatnonzero(kinds[a + 1 : b] >= 0) + a + 1, b]
            for c, d in zip(inner, inner[1:]):
                if d - c > room:
                    step = max(1, room // 2)
                    for t in range(c + step, d, step):
                        while t < d and not whole[t]:
                            t += 1
                        if t < d and kinds[t] < 0:
                            kinds[t] = TOKEN
    edges = [0, *(np.flatnonzero(kinds[1:n] >= 0) + 1).tolist(), n]
    m = len(edges) - 1  # atoms
    nxt, prv = list(range(1, m + 1)), list(range(-1, m - 1))
    size = [b - a for a, b in zip(edges, edges[1:])]
    alive = [True] * m
    heap = [(int(kinds[edges[i + 1]]), size[i] + size[i + 1], i, size[i], size[i + 1]) for i in range(m - 1)]
    heapq.heapify(heap)
    while heap:
        kind, both, i, left, right = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= m or size[i] != left or size[j] != right:
            continue  # an old entry; the pair that took its place has its own
        if both > (limit if i == 0 else room):
            continue
        size[i] = both
        alive[j] = False
        nxt[i] = nxt[j]
        if nxt[j] < m:
            prv[nxt[j]] = i
            heapq.heappush(heap, (int(kinds[edges[nxt[i]]]), both + size[nxt[i]], i, both, size[nxt[i]]))
        if i > 0:
            p = prv[i]
            heapq.heappush(heap, (int(kinds[edges[i]]), size[p] + both, p, size[p], both))
    out = []
    i = 0
    while i < m:
        a, b = edges[i], edges[i] + size[i]
        s = max(0, a - overlap) if a else 0
        while s < a and not whole[s]:
            s += 1
        out.append((int(chars[s]), int(chars[b]), s, b - s, a - s, KINDS[kinds[a]] if a else "start"))
        i = nxt[i]
    return out


def split_oversized(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER) -> DataFrame:
    """The pieces of every document of more than ``limit`` tokens, in order.

    ``doc_id``, ``piece_no``, ``char_start``, ``char_end``, ``token_start``,
    ``n_tokens``, ``overlap_tokens``, ``boundary`` (kind of the cut before the
    piece) and ``piece`` (the text between the two places). Null, empty and
    fitting texts give no rows; repeated rows give their pieces each; texts
    without any natural boundary are cut between tokens. No shuffle.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be smaller than half the limit")
    schema = "doc_id bigint, piece_no int, char_start bigint, char_end bigint, token_start bigint, n_tokens int, overlap_tokens int, boundary string, piece string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, sizes = encoder(path)
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"]):
                if text:
                    out += [(doc, k, *p, text[p[0] : p[1]]) for k, p in enumerate(cut(text, enc, sizes, limit, overlap))]
            yield pd.DataFrame(out, columns=["doc_id", "piece_no", "char_start", "char_end", "token_start", "n_tokens", "overlap_tokens", "boundary", "piece"])

    return documents.select("doc_id", "text").where("text is not null").mapInPandas(run, schema)
