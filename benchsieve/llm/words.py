"""Canonical words of a text: one integer per word, with typed placeholders.

A formula (delimited or not) is one word whatever its notation; numbers, units
and identifiers become placeholders; case, punctuation, tags and other markup
signs do not count. Han signs are words of their own.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np

FORMULA, NUMBER, UNIT, NAME = 0, 1, 2, 3
FIRST_WORD = 4
#: Words that are not in the vocabulary: content words, and small ones; and what stands between joined texts.
UNKNOWN, SMALL, BREAK = -1, -2, -9

CHUNK = re.compile(
    r"\$\$[^$]{1,600}\$\$|\$[^$]{1,300}\$|\\\(.{1,300}?\\\)|\\\[.{1,300}?\\\]|</?[A-Za-z!][^<>]{0,200}>|&[A-Za-z#0-9]{1,10};|[㐀-鿿]|[^\s㐀-鿿<$&]+|[<$&]"
)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MATHY = re.compile(r"[\\^=_Ͱ-Ͽ∀-⋿⁰-₟]")
_NUMBER = re.compile(r"[\d.,:/+\-−%]*\d[\d.,:/+\-−%]*")
_INNER = re.compile(r"[^\w]+")
#: Units of measure, fixed values.
UNITS = frozenset("hz khz mhz ghz thz db dbm dbi mw w kw ms us ns s m km cm mm bits bit bps kbps mbps gbps symbols slots users".split())
#: Frequent function words of four letters or more, fixed values.
FUNCTION = frozenset(
    "about after also although because been before being below between both came does doing down during each even every from further given have having here hence "
    "into itself just like made make many more most much must near once only other otherwise over same should since some such than that their them then there "
    "therefore these they this those through thus under until upon very were what when where whether which while whose will with within without would your "
    "aber auch auf als bei dass dem den der des die durch eine einem einen einer eines für ist mit nach nicht noch oder sich sind sowie über und unter von vor wird zwischen "
    "alors ainsi avec cette comme dans donc entre leur mais même nous par pas plus pour que qui sans sont sous sur tout une vers "
    "como cuando cuyo desde donde entre esta este hasta las los mientras muy para pero porque que sea según sin sobre son una y".split()
)


def canonical(chunk: str) -> str | int | None:
    """The word of a chunk, a placeholder's number, or None for signs and tags."""
    c = chunk[0]
    if c == "$" and len(chunk) > 1 or chunk.startswith(("\\(", "\\[")):
        return FORMULA
    if c == "<" or c == "&":
        return None
    s = unicodedata.normalize("NFKC", chunk).lower()
    bare = _EDGE.sub("", s)
    if "\\" in s and not re.match(r"\\(?:text|emph|sec|sub|par|item|begin|end|foot|cite|label|ref)", s) or _MATHY.search(bare):
        return FORMULA
    if not bare:
        return None
    if _NUMBER.fullmatch(bare):
        return NUMBER
    if bare in UNITS:
        return UNIT
    if "\\" in s:
        s = re.sub(r"\\[a-z]+\*?|[{}\[\]]", " ", s)
        bare = _EDGE.sub("", s)
    bare = _INNER.sub("", bare)
    if not bare:
        return None
    if len(bare) == 1 and bare.isascii() and bare not in "ai" or (len(bare) <= 3 and any(x.isdigit() for x in bare)):
        return NAME
    return bare


def is_content(word: str) -> bool:
    return len(word) >= 4 and word not in FUNCTION or "㐀" <= word[0] <= "鿿"


_DELIMITERS = re.compile(r"\\\\(?:left|right|[()\\[\\],;!: ])|[\\s${}\\\\]")


def value_of(chunk: str) -> int:
    """A number for what fills a slot (a formula, number, unit or name), whatever its notation; 0 for words, signs and tags."""
    w = canonical(chunk)
    if not isinstance(w, int):
        return 0
    s = _DELIMITERS.sub("", unicodedata.normalize("NFKC", chunk).lower())
    if w == FORMULA:
        s = "".join(unicodedata.name(x, x).rsplit(" ", 1)[-1].lower() if "Ͱ" <= x <= "Ͽ" else x for x in s if x.isalnum())
    else:
        s = _EDGE.sub("", s)
    return zlib.crc32(s.encode()) + 1


class Words(dict):
    """Chunk to tuple of word numbers; fills itself, and is emptied when large.

    With ``grow`` new words get numbers; else they are UNKNOWN or SMALL.
    """

    def __init__(self, vocabulary: dict[str, int], grow: bool, most: int = 400_000) -> None:
        super().__init__()
        self.vocabulary, self.grow, self.most = vocabulary, grow, most

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        w = canonical(chunk)
        if w is None:
            out: tuple[int, ...] = ()
        elif isinstance(w, int):
            out = (w,)
        elif self.grow:
            out = (self.vocabulary.setdefault(w, len(self.vocabulary) + FIRST_WORD),)
        else:
            n = self.vocabulary.get(w)
            out = (n,) if n is not None else (UNKNOWN if is_content(w) else SMALL,)
        if len(self) >= self.most:
            self.clear()
        self[chunk] = out
        return out

    def read(self, text: str | None) -> np.ndarray:
        """The word numbers of ``text``; a run of formulas is one."""
        if not text:
            return np.zeros(0, dtype=np.int64)
        ids = np.fromiter(chain.from_iterable(map(self.__getitem__, CHUNK.findall(text))), dtype=np.int64)
        return ids[_first(ids)] if len(ids) > 1 else ids

    def values(self, text: str, places: np.ndarray | None = None) -> np.ndarray:
        """What fills the slots at ``places`` in the words of ``text`` (all words if None; 0 for such that are no slots)."""
        chunks = CHUNK.findall(text)
        got = [self[c] for c in chunks]
        of = np.repeat(np.arange(len(got)), np.fromiter(map(len, got), dtype=np.int64, count=len(got)))
        ids = np.fromiter(chain.from_iterable(got), dtype=np.int64)
        first = np.flatnonzero(_first(ids))
        end = np.concatenate((first[1:], [len(ids)]))
        out = np.zeros(len(first) if places is None else len(places), dtype=np.int64)
        for n, p in enumerate(range(len(first)) if places is None else places.tolist()):
            if 0 <= ids[first[p]] < FIRST_WORD:
                out[n] = sum(value_of(chunks[of[q]]) for q in range(first[p], end[p]))
        return out


def _first(ids: np.ndarray) -> np.ndarray:
    """All words but such formulas as follow a formula."""
    return np.concatenate((np.ones(min(1, len(ids)), dtype=bool), (ids[1:] != FORMULA) | (ids[:-1] != FORMULA)))


class Words(dict):
    """Chunk to tuple of word numbers; fills itself, and is emptied when large.

    With ``grow`` new words get numbers; else they are UNKNOWN or SMALL.
    """

    def __init__(self, vocabulary: dict[str, int], grow: bool, most: int = 400_000) -> None:
        super().__init__()
        self.vocabulary, self.grow, self.most = vocabulary, grow, most

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        w = canonical(chunk)
        if w is None:
            out: tuple[int, ...] = ()
        elif isinstance(w, int):
            out = (w,)
        elif self.grow:
            out = (self.vocabulary.setdefault(w, len(self.vocabulary) + FIRST_WORD),)
        else:
            n = self.vocabulary.get(w)
            out = (n,) if n is not None else (UNKNOWN if is_content(w) else SMALL,)
        if len(self) >= self.most:
            self.clear()
        self[chunk] = out
        return out

    def read(self, text: str | None) -> np.ndarray:
        """The word numbers of ``text``; a run of formulas is one."""
        if not text:
            return np.zeros(0, dtype=np.int64)
        ids = np.fromiter(chain.from_iterable(map(self.__getitem__, CHUNK.findall(text))), dtype=np.int64)
        return ids[_first(ids)] if len(ids) > 1 else ids

    def values(self, text: str, places: np.ndarray | None = None) -> np.ndarray:
        """What fills the slots at ``places`` in the words of ``text`` (all words if None; 0 for such that are no slots)."""
        chunks = CHUNK.findall(text)
        got = [self[c] for c in chunks]
        of = np.repeat(np.arange(len(got)), np.fromiter(map(len, got), dtype=np.int64, count=len(got)))
        ids = np.fromiter(chain.from_iterable(got), dtype=np.int64)
        first = np.flatnonzero(_first(ids))
        end = np.concatenate((first[1:], [len(ids)]))
        out = np.zeros(len(first) if places is None else len(places), dtype=np.int64)
        for n, p in enumerate(range(len(first)) if places is None else places.tolist()):
            if 0 <= ids[first[p]] < FIRST_WORD:
                out[n] = sum(value_of(chunks[of[q]]) for q in range(first[p], end[p]))
        return out


def _first(ids: np.ndarray) -> np.ndarray:
    """All words but such formulas as follow a formula."""
    return np.concatenate((np.ones(min(1, len(ids)), dtype=bool), (ids[1:] != FORMULA) | (ids[:-1] != FORMULA)))


class Values(dict):
    """Chunk to the word's kind (a placeholder's number, or ``FIRST_WORD``) and what fills it, with formulas of its own; fills itself."""

    def __missing__(self, chunk: str) -> tuple[tuple[int, int], ...]:
        w = canonical(chunk)
        out = () if w is None else ((w, value_of(chunk)),) if isinstance(w, int) else ((FIRST_WORD, 0),)
        if len(self) >= 400_000:
            self.clear()
        self[chunk] = out
        return out

    def read(self, text: str | None) -> np.ndarray:
        """What fills each word of ``text``, in the places of ``Words.read``; 0 for words that are no slots."""
        got = np.array([x for c in CHUNK.findall(text or "") for x in self[c]], dtype=np.int64).reshape(-1, 2)
        if len(got) > 1:  # a run of formulas is one
            kind = got[:, 0]
            first = np.flatnonzero(np.concatenate(([True], (kind[1:] != FORMULA) | (kind[:-1] != FORMULA))))
            return np.add.reduceat(got[:, 1], first)
        return got[:, 1]


class ContentHashes(dict):
    """Chunk to the hashes of its content words, the same in every task; Han signs have odd hashes, other words even ones."""

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        w = canonical(chunk)
        if not isinstance(w, str) or not is_content(w):
            out: tuple[int, ...] = ()
        else:
            h = int.from_bytes(blake2b(w.encode(), digest_size=7).digest()) << 1
            out = (h + (len(w) == 1 and "㐀" <= w <= "鿿"),)
        if len(self) >= 400_000:
            self.clear()
        self[chunk] = out
        return out

    def read(self, text: str | None) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, CHUNK.findall(text or ""))), dtype=np.int64)


def mixed(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of as many arrays of hashes, in their order; never negative."""
    h = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(2)).astype(np.int64)


def hashed_windows(content: np.ndarray) -> np.ndarray:
    """Different hashes of the windows that ``shingles`` has, of words given as ``ContentHashes``."""
    n = len(content)
    if n < 3:
        return np.zeros(0, dtype=np.int64)
    h = np.concatenate(([0], np.cumsum(content & 1)))
    own = np.flatnonzero((h[3:] - h[:-3]) < 3)
    out = [mixed([content[own + j] for j in range(3)])]
    if n >= HAN_RUN:
        run = np.flatnonzero((h[HAN_RUN:] - h[:-HAN_RUN]) == HAN_RUN)
        out.append(mixed([content[run + j] for j in range(HAN_RUN)]))
    return np.unique(np.concatenate(out))


#: Numbers of words fit in as many bits, so that three of them make one exact key.
WORD_BITS = 21


#: A key of Han text covers so many signs.
HAN_RUN = 8


#: Places beside a window of three content words, from its first.
BESIDE = (-2, -1, 3, 4)


#: Signs of padding before and after each text in ``ShingleIndex.flat``, and between joined texts.
PAD = 16


def shingles(content: np.ndarray, han: np.ndarray | None = None, slots: np.ndarray | None = None) -> np.ndarray:
    """Keys of template windows: three content words in a row and the typed placeholders among them; -1 where a word is unknown.

    ``slots`` has for each content word a number for the placeholders right
    before it. ``han`` marks single Han signs: three of those say little, so a
    key that starts in a run of them covers ``HAN_RUN`` signs.
    """
    n = len(content)
    if n < 3:
        return np.zeros(0, dtype=np.int64)
    a, b, c = content[:-2], content[1:-1], content[2:]
    key = (a << (2 * WORD_BITS)) | (b << WORD_BITS) | c
    if slots is not None:
        key ^= ((slots[1:-1] * 0x9E3779B1 + slots[2:] * 0x85EBCA77) & 0xFFFFFFF) << 30
        key &= (1 << 62) - 1
    key[(a < 0) | (b < 0) | (c < 0)] = -1
    if han is not None and han.any():
        h = np.concatenate(([0], np.cumsum(han)))
        key[(h[3:] - h[:-3]) == 3] = -1
        if n >= HAN_RUN:
            whole = np.flatnonzero((h[HAN_RUN:] - h[:-HAN_RUN]) == HAN_RUN)
            mixed = np.zeros(len(whole), dtype=np.uint64)
            for j in range(HAN_RUN):
                mixed = mixed * np.uint64(1000003) + content[whole + j].astype(np.uint64)
            mixed ^= mixed >> np.uint64(29)
            key[whole] = (mixed & np.uint64((1 << 62) - 1)).astype(np.int64) | (1 << 62)
    return key


#: What a placeholder of each type adds to the number of its gap.
_SLOT = np.array([1, 1 << 5, 1 << 10, 1 << 15], dtype=np.int64)


def slot_codes(ids: np.ndarray, where: np.ndarray) -> np.ndarray:
    """For each content word, at ``where`` in ``ids``, a number for the placeholders between it and the one before."""
    n = np.where((ids >= 0) & (ids < FIRST_WORD), _SLOT[np.clip(ids, 0, FIRST_WORD - 1)], 0)
    return np.diff(np.cumsum(n)[where], prepend=0)


class ShingleIndex:
    """Template windows of a bounded block of texts, for scanning other texts.

    Every window is an anchor, however many texts share it. The words of
    ``contexts`` are known to the index too, but no anchors. With ``slots`` the
    typed placeholders among the content words are part of a window, and what
    fills the slots of each text is kept.
    """

    def __init__(self, keys: list, texts: list[str | None], contexts: Iterable[str | None] = (), slots: bool = False) -> None:
        self.keys, self.slots = keys, slots
        self.vocabulary: dict[str, int] = {}
        words = Words(self.vocabulary, grow=True)
        self.words = [words.read(t).astype(np.int32) for t in texts]
        self.context_words = [words.read(t).astype(np.int32) for t in contexts]
        self.values = [words.values(t) if t else np.zeros(0, dtype=np.int64) for t in texts] if slots else []
        if len(self.vocabulary) + FIRST_WORD >= 1 << WORD_BITS:
            raise ValueError("a block holds too many different words; use more blocks")
        self.content = np.zeros(len(self.vocabulary) + FIRST_WORD, dtype=bool)
        self.han = np.zeros(len(self.vocabulary) + FIRST_WORD, dtype=bool)
        for w, n in self.vocabulary.items():
            self.content[n] = is_content(w)
            self.han[n] = len(w) == 1 and "㐀" <= w <= "鿿"
        self.content_at = [np.flatnonzero(self.content[w]) for w in self.words]
        #: the content words of all texts in one array, padded with -8, their places in their texts, and where each text starts
        self.flat_len = np.array([len(c) for c in self.content_at], dtype=np.int64)
        self.flat_start = np.cumsum(np.concatenate(([PAD], self.flat_len + PAD)))[:-1]
        size = int((self.flat_len + PAD).sum()) + PAD
        self.flat, self.flat_at = np.full(size, -8, dtype=np.int32), np.zeros(size, dtype=np.int32)
        for at, w, c in zip(self.flat_start, self.words, self.content_at):
            self.flat[at : at + len(c)], self.flat_at[at : at + len(c)] = w[c], c
        self.han_share = np.array([self.han[w[c]].mean() if len(c) else 0.0 for w, c in zip(self.words, self.content_at)])
        self.flat_told = self._told()
        keyed = [shingles(w[c].astype(np.int64), self.han[w[c]], slot_codes(w, c) if slots else None) for w, c in zip(self.words, self.content_at)]
        lens = np.array([len(k) for k in keyed], dtype=np.int64)
        key = np.concatenate([*keyed, np.zeros(0, dtype=np.int64)])
        text = np.repeat(np.arange(len(keyed)), lens)
        place = np.arange(len(key)) - np.repeat(np.cumsum(lens) - lens, lens)
        keep = np.flatnonzero(key >= 0)
        keep = keep[np.argsort(key[keep], kind="stable")]
        #: different keys in order, where the rows of each start, and the rows: text and place in its content words
        self.key, first = np.unique(key[keep], return_index=True)
        self.row_start = np.concatenate((first, [len(keep)])).astype(np.int64)
        self.text, self.place = text[keep].astype(np.int32), place[keep].astype(np.int32)
        #: of each row, the words two before and two after its window, a byte each
        self.beside = self.bytes_at(self.flat, self.flat_start[text[keep]] + place[keep], BESIDE) if slots else np.zeros(0, dtype=np.uint32)

    @staticmethod
    def bytes_at(words: np.ndarray, at: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
        """Of four words so many ``steps`` from each place, a byte each; equal words have equal bytes."""
        out = np.zeros(len(at), dtype=np.uint32)
        for n, step in enumerate(steps):
            out |= (words[np.clip(at + step, 0, len(words) - 1)] & 255).astype(np.uint32) << np.uint32(8 * n)
        return out

    def _told(self) -> np.ndarray:
        """Bits that each content word tells beside its neighbours, over all texts: few for the fixed words of a template."""
        w = self.flat.astype(np.int64)
        if not len(self.words):
            return np.zeros(len(w), dtype=np.float32)
        n = np.bincount(np.maximum(w, 0))
        _, back, times = np.unique((w[:-1] << 32) + w[1:], return_inverse=True, return_counts=True)
        times = times[back]
        bits = np.full((2, len(w)), 8.0)
        at = np.flatnonzero((w[:-1] >= 0) & (w[1:] >= 0))
        bits[0, at + 1] = np.log2((n[w[at]] + 4) / times[at])
        bits[1, at] = np.log2((n[w[at + 1]] + 4) / times[at])
        return np.where(w >= 0, np.clip(bits.min(axis=0), 0, 8), 0).astype(np.float32)

    def told(self, t: int) -> np.ndarray:
        return self.flat_told[self.flat_start[t] : self.flat_start[t] + self.flat_len[t]]

    def reader(self) -> Words:
        return Words(self.vocabulary, grow=False)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors in the word numbers ``ids``: text, place in it, place in the content words; and the content words' places in ``ids``.

        ``BREAK`` counts as a content word, so that no window reaches over it.
        """
        (part,) = self.hits_in_parts(ids, None)
        return part

    def hits_in_parts(self, ids: np.ndarray, most: int | None = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``hits``, all of a text in one part; where windows of very many texts are met, in parts of about ``most`` rows."""
        for r, at, where in self.rows_in_parts(ids, most):
            yield self.text[r].astype(np.int64), self.place[r].astype(np.int64), at, where

    def rows_in_parts(self, ids: np.ndarray, most: int | None = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of the index that ``hits_in_parts`` meets, the places of their windows, in order, and the content words' places in ``ids``."""
        content = (ids == UNKNOWN) | (ids == BREAK) | ((ids >= FIRST_WORD) & self.content[np.maximum(ids, 0)])
        where = np.flatnonzero(content)
        got = ids[where]
        k = shingles(got, (got >= FIRST_WORD) & self.han[np.maximum(got, 0)], slot_codes(ids, where) if self.slots else None)
        at = np.flatnonzero(k >= 0)
        if len(self.key):
            spot = np.minimum(np.searchsorted(self.key, k[at]), len(self.key) - 1)
            some = self.key[spot] == k[at]
            at, spot = at[some], spot[some]
        else:
            at, spot = at[:0], at[:0]
        lo = self.row_start[spot]
        n = self.row_start[spot + 1] - lo if len(spot) else lo
        total = int(n.sum())
        parts = 1 if most is None else max(1, -(-total // most))
        cuts = np.searchsorted(np.cumsum(n), np.arange(1, parts) * (most or 1)) if parts > 1 else []
        for part in range(parts):
            rows, places = [], []
            for n_i, lo_i, at_i in zip(np.split(n, cuts), np.split(lo, cuts), np.split(at, cuts)):
                r = np.repeat(lo_i - (np.cumsum(n_i) - n_i), n_i) + np.arange(int(n_i.sum()))
                mine = slice(None) if parts == 1 else self.text[r] % parts == part
                rows.append(r[mine])
                places.append(np.repeat(at_i, n_i)[mine])
            r = np.concatenate(rows)
            yield r, np.concatenate(places), where
