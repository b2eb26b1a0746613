"""Problem 6: the same or nearly the same record in several splits.

The content-word n-grams of the evaluation records (three content words in a
row, which span five running words and more) are hashed and broadcast, or
written to files of hashes where they are too large for that; the training records are scanned for hits, and for each pair
with hits the containment of either question in the whole other record decides.
No window is left out, however many records share it. Short questions, whose
windows a few slips can all destroy, are looked for by their rarest words.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchsieve.llm.overlap import BLOCK_CHARS, broadcast_index
from benchsieve.llm.words import FIRST_WORD, UNKNOWN, ContentHashes, ShingleIndex, hashed_windows, mixed
from benchsieve.session import register_staged, shared_dir

EVALUATION = ("test", "validation")
#: Bodies of fewer content words need but one window; under ``FEW`` none, and so do Han bodies under ``FEW_HAN`` signs.
SHORT, FEW, FEW_HAN = 30, 20, 120
#: Bodies of fewer content words do not state a problem by themselves: the whole records must agree too.
BARE = 5


def _bag(ids: np.ndarray, index: ShingleIndex) -> Counter:
    """Content words with their numbers; Han signs in pairs."""
    got = np.where(ids >= FIRST_WORD, ids, 0)
    content = ids[((ids >= FIRST_WORD) & index.content[got]) | (ids == UNKNOWN)].astype(np.int64)
    han = (content >= FIRST_WORD) & index.han[np.maximum(content, 0)]
    bag = Counter(content[~han].tolist())
    if han.any():
        both = han[:-1] & han[1:]
        bag.update((content[:-1][both] * (1 << 24) + content[1:][both] + (1 << 50)).tolist())
    return bag


def _prefix(bags: dict[int, Counter], similarity: float) -> dict[int, list[int]]:
    """Word to the texts whose rarest words it is among: a record that holds ``similarity`` of a bag holds one of them."""
    df = Counter(w for bag in bags.values() for w in bag)
    post: dict[int, list[int]] = {}
    for t, bag in bags.items():
        left = int((1 - similarity) * sum(bag.values()) + 1e-9) + 1
        for w in sorted(bag, key=lambda w: (df[w], w)):
            post.setdefault(w, []).append(t)
            left -= bag[w]
            if left <= 0:
                break
    return post


def _contained(a: Counter, b: Counter) -> float:
    n = sum(a.values())
    return sum(min(v, b[w]) for w, v in a.items() if w >= 0 and w in b) / n if n else 0.0


def _wanted(content: int, han: int) -> tuple[bool, bool]:
    """Whether a body of so many content words, so many of them Han signs, needs no window, and whether one is enough."""
    few = content < FEW or 2 * han > 0.6 * content and content < FEW_HAN
    return few, content < SHORT


def near_pairs(evaluation: DataFrame, training: DataFrame, similarity: float = 0.8, min_hits: int = 3, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``eval_key``, ``train_key``, ``hits``, ``eval_contained``, ``train_contained``.

    Both tables have ``key``, ``body`` and ``context``. A pair counts if the
    body of either record is contained in the other record, context and all, to
    at least ``similarity`` of its content words: a context may be missing or
    moved into the body, and sharing only a context is not enough. Sentence
    order, case, layout and notation do not matter. A body of fewer than ``BARE``
    content words says too little, so then one whole record must be contained in
    the other too. ``hits`` is the number of shared windows, which may be none for
    short bodies. Records whose body has no content words match nothing; rows with equal keys are compared each; empty tables
    give no rows.

    Evaluation records of up to ``block_chars`` characters are broadcast, and
    training records are scanned where they are, without a shuffle. More are
    hashed into files of that size, which all tasks map into memory; either side
    is read once, and neither hashes nor pairs are shuffled.
    """
    ev, tr = (t.select("key", "body", "context").where("body is not null") for t in (evaluation, training))
    size = ev.select(F.sum(F.length("body") + F.coalesce(F.length("context"), F.lit(0))).alias("n")).first()["n"] or 0
    return _broadcast(ev, tr, similarity, min_hits) if size <= block_chars else _partitioned(ev, tr, similarity, min_hits, max(block_chars, 0))


SCHEMA = "eval_key string, train_key string, hits int, eval_contained double, train_contained double"


def _broadcast(ev: DataFrame, tr: DataFrame, similarity: float, min_hits: int) -> DataFrame:
    spark = tr.sparkSession
    rows = ev.orderBy("key").collect()
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    shared = broadcast_index(spark, rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        reader = index.reader()
        bags: dict[int, tuple[Counter, Counter]] = {}

        def evaluated(t: int) -> tuple[Counter, Counter]:
            if t not in bags:
                own = index.words[t].astype(np.int64)
                bags[t] = (_bag(own, index), _bag(np.concatenate((index.context_words[t].astype(np.int64), own)), index))
            return bags[t]

        size = index.flat_len
        han = np.array([int(index.han[w].sum()) for w in index.words])
        few, single = (np.array(x, dtype=bool) for x in zip(*map(_wanted, size.tolist(), han.tolist())))
        post = _prefix({t: evaluated(t)[0] for t in np.flatnonzero(few).tolist()}, similarity)
        need = np.where(single, 1, min_hits)

        for b in batches:
            out = []
            for key, body, context in zip(b["key"], b["body"], b["context"]):
                own = reader.read(body)
                whole = np.concatenate((reader.read(context), own))
                text, place, _, _ = index.hits(whole)
                pairs = np.unique(text * (1 << 32) + place) >> 32
                near, hits = np.unique(pairs, return_counts=True)
                enough = hits >= need[near]
                bag, bag_whole = _bag(own, index), _bag(whole, index)
                n_hits = dict(zip(near[enough].tolist(), hits[enough].tolist()))
                if post:
                    count = dict(zip(near.tolist(), hits.tolist()))
                    for w in bag_whole:
                        for t in post.get(w, ()):
                            n_hits.setdefault(t, count.get(t, 0))
                for t, n in n_hits.items():
                    got = agreement(*evaluated(t), bag, bag_whole, similarity)
                    if got:
                        out.append((index.keys[t], key, n, *got))
            yield pd.DataFrame(out, columns=["eval_key", "train_key", "hits", "eval_contained", "train_contained"])

    return tr.mapInPandas(run, SCHEMA)


def agreement(e: Counter, e_whole: Counter, t: Counter, t_whole: Counter, similarity: float) -> tuple[float, float] | None:
    """How much of either body the other record holds, if enough for a pair."""
    c1 = _contained(e, t_whole)
    if c1 < similarity:
        return None
    c2 = _contained(t, e_whole)
    if c2 < similarity:
        return None
    if min(e.total(), t.total()) < BARE and max(_contained(e_whole, t_whole), _contained(t_whole, e_whole)) < similarity:
        return None
    return c1, c2


def _hash_bag(content: np.ndarray) -> Counter:
    """As ``_bag``, of words given as hashes."""
    han = (content & 1).astype(bool)
    bag = Counter(content[~han].tolist())
    if han.any():
        both = np.flatnonzero(han[:-1] & han[1:])
        bag.update(mixed([content[both], content[both + 1]]).tolist())
    return bag


def _lists(groups: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, where the texts of each start, and the texts."""
    hashes = sorted(groups)
    start = np.cumsum([0, *(len(groups[h]) for h in hashes)])
    return np.array(hashes, dtype=np.int64), start, np.array([t for h in hashes for t in groups[h]], dtype=np.int32)


def _arrays(bag: Counter) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(bag, dtype=np.int64, count=len(bag)), np.fromiter(bag.values(), dtype=np.int32, count=len(bag))


def _flat(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, how often each, and where each bag starts."""
    return np.concatenate([w for w, _ in bags]), np.concatenate([n for _, n in bags]), np.cumsum([0, *(len(w) for w, _ in bags)])


def _masks(word: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Four numbers for each bag, whose 256 bits mark hashes of its words: a bit that another bag lacks is a word that it lacks."""
    out = np.zeros((4, len(start) - 1), dtype=np.uint64)
    for i in range(0, len(start) - 1, 10_000):
        own = start[i : i + 10_001]
        bit = np.zeros((len(own) - 1, 256), dtype=bool)
        bit[np.repeat(np.arange(len(own) - 1), np.diff(own)), _slot(word[own[0] : own[-1]], 8)] = True
        out[:, i : i + len(own) - 1] = np.packbits(bit, axis=1).view(np.uint64).T
    return out


def _lack(n: np.ndarray, start: np.ndarray, similarity: float) -> np.ndarray:
    """How many words of each bag a record that holds ``similarity`` of it may lack."""
    total = np.diff(np.concatenate(([0], np.cumsum(n)))[start])
    return np.floor((1 - similarity) * total + 1e-6).astype(np.int16)


class HashBlock(NamedTuple):
    """Hashes of a bounded number of evaluation records; each array is read where it lies in a file."""

    key: np.ndarray  # different window hashes in order, where the records of each start, and the records
    row_start: np.ndarray
    text: np.ndarray
    rare: np.ndarray  # the same of the rarest words of short bodies
    rare_start: np.ndarray
    rare_text: np.ndarray
    single: np.ndarray  # whether one window is enough
    mask: np.ndarray  # of the words of the bodies, as ``_masks`` has them, and how many words a record may lack
    lack: np.ndarray
    whole_mask: np.ndarray
    word: np.ndarray  # words of the bodies
    n: np.ndarray
    start: np.ndarray
    whole_word: np.ndarray  # and of the bodies with their contexts
    whole_n: np.ndarray
    whole_start: np.ndarray
    name: np.ndarray  # keys of the records, in UTF-8
    name_start: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, str, str | None]], words: ContentHashes, similarity: float) -> HashBlock:
        windows, bags, wholes, single, short = [], [], [], [], {}
        for t, (_, body, context) in enumerate(rows):
            own = words.read(body)
            few, one = _wanted(len(own), int((own & 1).sum()))
            windows.append(hashed_windows(own))
            bag = _hash_bag(own)
            bags.append(_arrays(bag))
            wholes.append(_arrays(_hash_bag(np.concatenate((words.read(context), own)))) if context else bags[-1])
            single.append(one)
            if few:
                short[t] = bag
        n, whole = _flat(bags), _flat(wholes)
        h = np.concatenate(windows)
        order = np.argsort(h, kind="stable")
        key, first = np.unique(h[order], return_index=True)
        text = np.repeat(np.arange(len(rows), dtype=np.int32), [len(w) for w in windows])[order]
        names = [k.encode() for k, _, _ in rows]
        return cls(
            key, np.append(first, len(h)), text, *_lists(_prefix(short, similarity)), np.array(single, dtype=np.uint8),
            _masks(n[0], n[2]).ravel(), _lack(n[1], n[2], similarity), _masks(whole[0], whole[2]).ravel(), *n, *whole,
            np.frombuffer(b"".join(names), dtype=np.uint8), np.cumsum([0, *map(len, names)]),
        )

    def write(self, uri: str) -> None:
        fs, path = FileSystem.from_uri(uri)
        batch = pa.record_batch([pa.ListArray.from_arrays([0, len(x)], pa.array(x)) for x in self], names=self._fields)
        with fs.open_output_stream(path) as out, pa.ipc.new_file(out, batch.schema) as file:
            file.write_batch(batch)

    @classmethod
    def open(cls, uri: str) -> HashBlock:
        """A file of the machine is mapped, so that all workers share its pages; another is read."""
        fs, path = FileSystem.from_uri(uri)
        file = pa.memory_map(path) if isinstance(fs, LocalFileSystem) else pa.BufferReader(fs.open_input_file(path).read_buffer())
        batch = pa.ipc.open_file(file).get_batch(0)
        return cls(*(batch.column(i).values.to_numpy() for i in range(batch.num_columns)))

    def eval_key(self, t: int) -> str:
        return self.name[self.name_start[t] : self.name_start[t + 1]].tobytes().decode()

    def bags(self, t: int) -> tuple[Counter, Counter]:
        return tuple(Counter(dict(zip(w[s[t] : s[t + 1]].tolist(), n[s[t] : s[t + 1]].tolist()))) for w, n, s in ((self.word, self.n, self.start), (self.whole_word, self.whole_n, self.whole_start)))


def _rows(keys: np.ndarray, start: np.ndarray, text: np.ndarray, hashes: np.ndarray, of: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Record and text for each hash they share, in parts of about ``most`` rows; all rows of a record are in one part. ``hashes`` are in order, ``of`` has the record of each."""
    if not len(keys) or not len(hashes):
        return
    spot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    some = np.flatnonzero(keys[spot] == hashes)
    some = some[np.argsort(of[some], kind="stable")]
    spot, of = spot[some], of[some]
    low = start[spot]
    n = start[spot + 1] - low
    done = np.cumsum(n)
    i = 0
    while i < len(of):
        before = done[i] - n[i]
        j = int(np.searchsorted(done, before + most, "right"))
        j = max(int(np.searchsorted(of, of[j], "left")), int(np.searchsorted(of, of[i], "right"))) if j < len(of) else j
        own = n[i:j]
        r = np.repeat(low[i:j] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        yield np.repeat(of[i:j], own), text[r]
        i = j


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Scanned(NamedTuple):
    """Training records that are looked for together: hashes of windows and of words in order with the record of each, and masks as evaluation records have."""

    windows: tuple[np.ndarray, np.ndarray]
    words: tuple[np.ndarray, np.ndarray]
    mask: np.ndarray
    lack: np.ndarray
    whole_mask: np.ndarray

    @classmethod
    def of(cls, own: list[np.ndarray], whole: list[np.ndarray], similarity: float) -> Scanned:
        bags, wholes = _flat([_arrays(_hash_bag(x)) for x in own]), _flat([_arrays(_hash_bag(x)) for x in whole])
        windows = [hashed_windows(x) for x in whole]
        return cls(
            _ordered(np.concatenate(windows), np.array([len(x) for x in windows])), _ordered(wholes[0], np.diff(wholes[2])),
            _masks(bags[0], bags[2]).ravel(), _lack(bags[1], bags[2], similarity), _masks(wholes[0], wholes[2]).ravel(),
        )


def _ordered(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    return h[order], np.repeat(np.arange(len(size)), size)[order]


def _candidates(block: HashBlock, scanned: Scanned, min_hits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a training record and an evaluation record with enough windows or a rare word in common, and how many windows; without most of those that lack too many words of each other."""
    many = len(block.single)

    def like(of: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The pairs that may be alike, as one number."""
        for mine, theirs, lack, turned in ((block.mask, scanned.whole_mask, block.lack, True), (scanned.mask, block.whole_mask, scanned.lack, False)):
            m, k = len(mine) // 4, len(theirs) // 4
            lost = np.zeros(len(of), dtype=np.int16)
            for c in range(4):
                left, right = (text, of) if turned else (of, text)
                lost += np.bitwise_count(mine[c * m : (c + 1) * m][left] & ~theirs[c * k : (c + 1) * k][right])
                if c % 2:
                    some = np.flatnonzero(lost <= lack[left])
                    of, text, lost = of[some], text[some], lost[some]
        return of * many + text

    rare = [like(*x) for x in _rows(block.rare, block.rare_start, block.rare_text, *scanned.words)]
    rare = np.unique(np.concatenate(rare)) if rare else np.zeros(0, dtype=np.int64)
    pairs, hits = [], []
    for x in _rows(block.key, block.row_start, block.text, *scanned.windows):
        p, n = np.unique(like(*x), return_counts=True)
        ok = (n >= np.where(block.single[p % many] > 0, 1, min_hits)) | np.isin(p, rare)
        pairs.append(p[ok])
        hits.append(n[ok])
    left = np.setdiff1d(rare, np.concatenate([*pairs, rare[:0]]))
    p, n = np.concatenate([*pairs, left]), np.concatenate([*hits, np.zeros(len(left), dtype=np.int64)])
    return p // many, p % many, n


#: Training records that are looked for together.
GROUP = 4_000


def _partitioned(ev: DataFrame, tr: DataFrame, similarity: float, min_hits: int, block_chars: int) -> DataFrame:
    """Evaluation records are hashed into files of at most ``block_chars`` characters or one record, in tasks; training records meet one file after the other in one scan, so no pair is ever shuffled."""
    folder = f"{shared_dir(tr.sparkSession).rstrip('/')}/eval-hashes-{uuid.uuid4().hex}"
    fs, path = FileSystem.from_uri(folder)
    fs.create_dir(path)
    register_staged(folder)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = ContentHashes()
        rows, signs = [], 0

        def written() -> pd.DataFrame:
            uri = f"{folder}/{uuid.uuid4().hex}"
            HashBlock.of(rows, words, similarity).write(uri)
            return pd.DataFrame({"uri": [uri]})

        for b in batches:
            for row in zip(b["key"], b["body"], b["context"]):
                more = len(row[1]) + len(row[2] or "")
                if rows and signs + more > block_chars:
                    yield written()
                    rows, signs = [], 0
                rows.append(row)
                signs += more
        if rows:
            yield written()

    group = GROUP
    uris = [r["uri"] for r in ev.coalesce(max(1, tr.sparkSession.sparkContext.defaultParallelism)).mapInPandas(build, "uri string").collect()]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = ContentHashes()
        blocks = [HashBlock.open(u) for u in uris]
        for batch in batches:
            for i in range(0, len(batch), group):
                yield pd.DataFrame(met(batch[i : i + group], words, blocks), columns=["eval_key", "train_key", "hits", "eval_contained", "train_contained"])

    def met(b: pd.DataFrame, words: ContentHashes, blocks: list[HashBlock]) -> list[tuple]:
        own = [words.read(x) for x in b["body"]]
        whole = [np.concatenate((words.read(c), o)) for c, o in zip(b["context"], own)]
        scanned = Scanned.of(own, whole, similarity)
        out = []
        mine: dict[int, tuple[Counter, Counter]] = {}
        for block in blocks:
            theirs: dict[int, tuple[Counter, Counter]] = {}
            for d, t, n in zip(*(x.tolist() for x in _candidates(block, scanned, min_hits))):
                if t not in theirs:
                    theirs[t] = block.bags(t)
                if d not in mine:
                    mine[d] = (_hash_bag(own[d]), _hash_bag(whole[d]))
                got = agreement(*theirs[t], *mine[d], similarity)
                if got:
                    out.append((block.eval_key(t), b["key"].iat[d], n, *got))
        return out

    return tr.mapInPandas(scan, SCHEMA)


def _records(problems: DataFrame) -> DataFrame:
    split = F.lower(F.trim("split"))
    body, context = F.coalesce("question_text", F.lit("")), F.coalesce("background", F.lit(""))
    return problems.select(
        "problem_id", split.alias("split"), F.col("question_text").alias("body"), F.col("background").alias("context"),
        F.sha2(F.concat(F.length(context).cast("string"), F.lit(":"), context, body), 256).alias("key"),
    )


def cross_split_classes(problems: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Near pairs between classes of exact copies, and the members of each class.

    Copies of a record are compared once, whatever their number; pairs of
    records follow from pairs of classes and the membership table.
    """
    rec = _records(problems)
    one = lambda part: part.groupBy("key").agg(F.first("body").alias("body"), F.first("context").alias("context"))
    pairs = near_pairs(one(rec.where(F.col("split").isin(*EVALUATION))), one(rec.where("split = 'train'")), similarity)
    return pairs, rec.select("key", "problem_id", "split")


def cross_split_pairs(problems: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``problem_id_a`` < ``problem_id_b``, one in train and one in an evaluation split, and the evaluation one's id and split."""
    pairs, members = cross_split_classes(problems, similarity)
    ev = members.where(F.col("split").isin(*EVALUATION)).select(F.col("key").alias("eval_key"), F.col("problem_id").alias("eval_id"), F.col("split").alias("eval_split"))
    tr = members.where("split = 'train'").select(F.col("key").alias("train_key"), F.col("problem_id").alias("train_id"))
    return pairs.join(ev, "eval_key").join(tr, "train_key").select(
        F.least("eval_id", "train_id").alias("problem_id_a"), F.greatest("eval_id", "train_id").alias("problem_id_b"), "eval_id", "eval_split", "train_id",
    ).distinct()
