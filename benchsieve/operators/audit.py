"""Overlap audit: n-grams of problems found in a corpus of documents.

Problems (``problem_id``, ``text``) are the small side, documents (``doc_id``,
``text``, ``slice``) the large one. Both are sifted by a bitmap of the other's
n-grams, and what is left is shuffled on the n-gram; other probes are broadcast
if a count shows that they are small.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchsieve.functions.text import gram_count, gram_keys, gram_text, tokens, word_hashes
from benchsieve.session import stage_table

#: Bytes up to which a table of keys is broadcast, at ``ROW_BYTES`` a row in the hashed form that executors hold.
BROADCAST_BYTES = 192 << 20
ROW_BYTES = 96
PROBE_ROWS = BROADCAST_BYTES // ROW_BYTES
#: Bits of a bitmap for each key, and at most: 32 MB, which the driver and every task hold.
SIEVE_BITS, SIEVE_MOST = 16, 1 << 28
S1_MOST = 2
ABORT_FLOOR = 150
EXAMPLES = 20
SWEEP = (8, 10, 12, 13, 15)


def require_unique(problems: DataFrame, key: str = "problem_id") -> DataFrame:
    """``problems`` unless a key is null or repeated, which would double counts."""
    bad = problems.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{key} {bad[0][0]!r} is null or repeated")
    return problems


def occurrences(texts: DataFrame, n: int, strip_markup: bool = True, more: tuple[int, ...] = ()) -> DataFrame:
    """``pos``, ``g1``, ``g2`` of every n-gram of ``text`` beside the other columns, repeats included.

    Places are exploded instead of keys: the keys are then built in generated
    code, one row at a time. ``g1`` is exploded too, so that what sifts by it has
    it as it is. With ``more``, greater numbers in order, ``longer`` has a key
    for the n-gram of each that starts at the place, null past the end; these
    continue each other and are only comparable among themselves.
    """
    rest = [c for c in texts.columns if c != "text"]
    places = F.when(F.size("hs") >= n, F.sequence(F.lit(0), F.size("hs") - F.lit(n)))
    part = [F.get("hs", F.col("pos") + F.lit(j)) for j in range(n)]
    at = texts.select(*rest, word_hashes("text", strip_markup).alias("hs")).select(*rest, "hs", F.explode(places).alias("pos"))
    keyed = at.select(*rest, "hs", "pos", F.explode(F.array(F.xxhash64(*part))).alias("g1"))
    g1, g2, longer = F.col("g1"), F.hash(*part), []
    out = [*rest, "pos", "g1", g2.alias("g2")]
    for low, high in zip((n, *more), more):
        part = [F.get("hs", F.col("pos") + F.lit(j)) for j in range(low, high)]
        g1, g2 = F.xxhash64(g1, *part), F.hash(g2, *part)
        longer.append(F.when(F.size("hs") >= F.col("pos") + F.lit(high), F.struct(g1.alias("g1"), g2.alias("g2"))))
    if more:  # in a lambda, which stays out of the generated code: that must be short to be compiled, and few rows come here
        out.append(F.flatten(F.transform(F.array(F.lit(0)), lambda _: F.array(*longer))).alias("longer"))
    return keyed.select(*out)


def probe(problems: DataFrame, n: int, strip_markup: bool = True) -> DataFrame:
    """Distinct (``problem_id``, ``g1``, ``g2``)."""
    return occurrences(problems.select("problem_id", "text"), n, strip_markup).select("problem_id", "g1", "g2").distinct()


def small(df: DataFrame, most: int = PROBE_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``most`` rows, else as it is.

    Then both sides are shuffled on the key; adaptive execution splits the
    partitions of stock n-grams, whose rows lie on the corpus side.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def corpus_grams(documents: DataFrame, n: int, strip_markup: bool = True) -> DataFrame:
    """``slice``, ``doc_id``, ``g1``, ``g2``, one row per occurrence, and its place."""
    return occurrences(documents.select("slice", "doc_id", "text"), n, strip_markup)


def bitmap(keys: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """A table of one row whose ``bits`` hold two bits for the ``g1`` of every key, and how many bits there are.

    It is put together by the executors; only the finished array, of at most ``SIEVE_MOST`` bits, passes through the driver.
    """
    most = min(SIEVE_MOST, max(1 << 18, 1 << (SIEVE_BITS * rows - 1).bit_length()))
    words = keys.select(F.explode(F.array(*_two_bits(most))).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    words = words.unionByName(keys.sparkSession.range(most >> 6).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bit")))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bit"))
    parts = words.groupBy(F.shiftright("word", 12).alias("part")).agg(F.sort_array(F.collect_list(F.struct("word", "bit")))["bit"].alias("bits"))
    return stage_table(parts.agg(F.flatten(F.sort_array(F.collect_list(F.struct("part", "bits")))["bits"]).alias("bits")), "bitmap"), most


def _two_bits(most: int) -> list[Column]:
    """Two places in a bitmap, from either end of ``g1``."""
    return [F.col("g1").bitwiseAND(F.lit(most - 1)), F.shiftrightunsigned("g1", 36).bitwiseAND(F.lit(most - 1))]


def sift(grams: DataFrame, of: tuple[DataFrame, int]) -> DataFrame:
    """The rows of ``grams`` that a bitmap may hold: all that it holds, and at 16 bits a key about one in seventy of the others."""
    table, most = of
    bits = table.select("bits").scalar()
    on = [F.call_function("getbit", F.get(bits, F.shiftright(at, 6)), at.bitwiseAND(F.lit(63)).cast("int")) == 1 for at in _two_bits(most)]
    return grams.where(on[0] & on[1])


def meet(texts: DataFrame, own: DataFrame, grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the n-grams ``own`` of ``texts`` and of ``grams`` those that both have, with few others, written once.

    ``grams`` are sifted by a bitmap of the own ones where they arise, then the
    own ones by a bitmap of what is left, so neither side is broadcast or
    shuffled whole. What is no match is left to the join on both halves of the key.
    """
    rows = texts.agg(F.sum(F.length("text"))).first()[0] or 0  # a word has some six signs; the bitmap's size decides no result
    there = stage_table(sift(grams, bitmap(own, rows // 6)), "there")
    return stage_table(sift(own, bitmap(there, there.count())), "own"), there


def matches(problems: DataFrame, documents: DataFrame, n: int, strip_markup: bool = True) -> DataFrame:
    """Per problem, slice, document and n-gram the number of occurrences.

    Written once in the shared folder: it holds only what matched, and several
    aggregations start from it, which would else scan the corpus once each.
    """
    mine = occurrences(problems.select("problem_id", "text"), n, strip_markup).drop("pos")
    own, there = meet(problems, mine, corpus_grams(documents, n, strip_markup).drop("pos"))
    # occurrences are added up before they meet the problems that share an n-gram
    in_doc = there.repartition("g1", "g2").groupBy("slice", "doc_id", "g1", "g2").agg(F.count(F.lit(1)).alias("c"))
    return stage_table(in_doc.join(own.repartition("g1", "g2").distinct(), ["g1", "g2"]).select("problem_id", "slice", "doc_id", "g1", "g2", "c"), "matches")


def by_slice(found: DataFrame) -> DataFrame:
    """``problem_id``, ``slice``, ``hits``, ``docs``, ``unique_ngrams``, in two steps that need no expansion for distinct counts."""
    docs = found.groupBy("problem_id", "slice", "doc_id").agg(F.sum("c").alias("c")).groupBy("problem_id", "slice").agg(F.sum("c").alias("hits"), F.count(F.lit(1)).alias("docs"))
    grams = found.groupBy("problem_id", "slice", "g1", "g2").agg(F.lit(1)).groupBy("problem_id", "slice").agg(F.count(F.lit(1)).alias("unique_ngrams"))
    return docs.join(grams, ["problem_id", "slice"])


def flags(docs: Column, hits: Column) -> list[Column]:
    """Strict and lenient clean flags on documents, and the lenient one on occurrences."""
    return [(docs == 0).alias("in_s0"), (docs <= S1_MOST).alias("in_s1"), (hits <= S1_MOST).alias("in_s1_hits")]


def audit(problems: DataFrame, documents: DataFrame, n: int = 13, strip_markup: bool = True) -> DataFrame:
    """One row per problem: ``n_grams_total``, ``hits_total``, ``docs_total``, ``unique_ngrams_total`` and flags.

    Totals are sums over slices; problems without a hit, and such with too few
    words for an n-gram, stay with zeros.
    """
    per = by_slice(matches(problems, documents, n, strip_markup))
    total = per.groupBy("problem_id").agg(F.sum("hits").alias("h"), F.sum("docs").alias("d"), F.sum("unique_ngrams").alias("u"))
    own = problems.select("problem_id", gram_count(tokens("text", strip_markup), n).alias("n_grams_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return own.join(total, "problem_id", "left").select(
        "problem_id", "n_grams_total", zero("h").alias("hits_total"), zero("d").alias("docs_total"), zero("u").alias("unique_ngrams_total"), *flags(zero("d"), zero("h"))
    )


def audit_nested(problems: DataFrame, documents: DataFrame, n: int = 13) -> DataFrame:
    """``problem_id`` with maps from slice to hits, documents and n-grams."""
    per = by_slice(matches(problems, documents, n))
    pack = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("slice", c)))).alias(f"per_slice_{c}")
    maps = per.groupBy("problem_id").agg(pack("hits"), pack("docs"), pack("unique_ngrams"))
    return problems.select("problem_id").join(maps, "problem_id", "left")


def forward_probe(problems: DataFrame, documents: DataFrame, n: int = 13) -> DataFrame:
    """Per problem and slice the number of its own n-gram places that occur in the slice; flags on these counts."""
    own = problems.select("problem_id", word_hashes("text").alias("hs")).select("problem_id", F.explode(gram_keys("hs", n)).alias("k")).select("problem_id", "k.g1", "k.g2")
    counted = small(stage_table(own.groupBy("problem_id", "g1", "g2").agg(F.count(F.lit(1)).alias("c")), "probe"))
    # each n-gram of a slice once: filter by the probe first, so that only what matches is made distinct
    hit = corpus_grams(documents, n).drop("pos", "doc_id").join(counted, ["g1", "g2"]).groupBy("slice", "problem_id", "g1", "g2").agg(F.max("c").alias("c"))
    per = hit.groupBy("problem_id").agg(F.sum("c").alias("h"))
    h = F.coalesce("h", F.lit(0))
    return problems.select("problem_id").join(per, "problem_id", "left").select("problem_id", h.alias("hits_total"), (h == 0).alias("in_s0"), (h <= S1_MOST).alias("in_s1"))


def examples(problems: DataFrame, documents: DataFrame, n: int = 13, most: int = EXAMPLES) -> DataFrame:
    """``problem_id``, ``slice``, ``rank``, ``doc_id``, ``pos``, ``ngram``: the first occurrences by document and place.

    The report of the audit shows so many; all occurrences are searched.
    """
    p = small(stage_table(probe(problems, n), "probe"))
    hit = corpus_grams(documents, n).join(p, ["g1", "g2"])
    w = Window.partitionBy("problem_id", "slice").orderBy("doc_id", "pos")
    top = stage_table(hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("problem_id", "slice", "rank", "doc_id", "pos"), "examples")
    words = documents.select("doc_id", tokens("text").alias("toks"))
    return words.join(small(top), "doc_id").select("problem_id", "slice", "rank", "doc_id", "pos", gram_text("toks", F.col("pos") + 1, n).alias("ngram"))


def sweep(problems: DataFrame, documents: DataFrame, ns: tuple[int, ...] = SWEEP) -> DataFrame:
    """``problem_id``, ``n``, ``docs_total``, ``hits_total``, ``in_s0`` for every n.

    The corpus is scanned once, for the least n. A longer n-gram matches only
    where the shorter one at its start does, so its keys are built there alone.
    """
    least, *more = sorted(ns)
    mine = occurrences(problems.select("problem_id", "text"), least, more=tuple(more)).drop("pos")
    own, there = meet(problems, mine, occurrences(documents.select("doc_id", "text"), least, more=tuple(more)).drop("pos"))

    def keys(rows: DataFrame, key: str) -> DataFrame:
        """``key``, ``i``, ``g1`` and ``g2`` for the i-th n, dealt by the last three, which are counted and joined where they lie."""
        every = F.concat(F.array(F.struct("g1", "g2")), "longer") if more else F.array(F.struct("g1", "g2"))
        return rows.select(key, F.posexplode(every).alias("i", "k")).where("k is not null").select(key, "i", "k.g1", "k.g2").repartition("i", "g1", "g2")

    # occurrences are added up before they meet the problems that share an n-gram
    in_doc = keys(there, "doc_id").groupBy("doc_id", "i", "g1", "g2").agg(F.count(F.lit(1)).alias("c"))
    hit = in_doc.join(keys(own, "problem_id").distinct(), ["i", "g1", "g2"]).groupBy("problem_id", "i", "doc_id").agg(F.sum("c").alias("c"))
    n = F.get(F.array(*map(F.lit, (least, *more))), F.col("i")).alias("n")
    per = stage_table(hit.groupBy("problem_id", "i").agg(F.sum("c").alias("h"), F.count(F.lit(1)).alias("d")).select("problem_id", n, "h", "d"), "sweep")
    every = problems.select("problem_id", F.explode(F.array(*[F.lit(n) for n in ns])).alias("n"))
    return every.join(per, ["problem_id", "n"], "left").select(
        "problem_id", "n", F.coalesce("d", F.lit(0)).alias("docs_total"), F.coalesce("h", F.lit(0)).alias("hits_total"), F.isnull("d").alias("in_s0")
    )


def disagreement(views: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Per pair of views with ``problem_id``, ``n`` and ``in_s0``: rows compared, and those in which they differ or that one lacks."""
    out = []
    for name, (a, b) in views.items():
        j = a.withColumnRenamed("in_s0", "a").join(b.withColumnRenamed("in_s0", "b"), ["problem_id", "n"], "full_outer")
        out.append(j.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n_compared"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_differ")))
    return reduce(DataFrame.unionByName, out)


def histogram(audited: DataFrame, col: str) -> DataFrame:
    return audited.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n_problems"))


def gate(audited: DataFrame, floor: int = ABORT_FLOOR) -> DataFrame:
    """``s1_count`` and whether it is under the floor; a warning, which stops nothing."""
    n = F.coalesce(F.sum(F.col("in_s1").cast("bigint")), F.lit(0))
    return audited.agg(n.alias("s1_count"), (n < floor).alias("below_floor"))


def flat(problems: DataFrame, documents: DataFrame, slices: list[str], n: int = 13) -> DataFrame:
    """The flat form of the audit: ``hits_x``, ``docs_x`` and ``unique_ngrams_x`` for each slice x, flags as 0 and 1."""
    per = by_slice(matches(problems, documents, n))
    wide = per.groupBy("problem_id").agg(*[F.sum(F.when(F.col("slice") == s, F.col(c))).alias(f"{c}_{s}") for s in slices for c in ("hits", "docs", "unique_ngrams")])
    base = problems.select("problem_id").join(wide, "problem_id", "left")
    return base.fillna(0)


def corpus_set_size(documents: DataFrame, n: int = 13) -> DataFrame:
    """Distinct and total n-grams per slice: the exact set of a corpus, built by a shuffle instead of in one memory."""
    g = corpus_grams(documents, n).groupBy("slice", "g1", "g2").agg(F.count(F.lit(1)).alias("c"))
    return g.groupBy("slice").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").alias("n_total"))


def bloom_size(items: int, rate: float = 1e-4) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for so many items at this rate of false positives."""
    bits = max(64, math.ceil(-items * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, items) * math.log(2)))


def bloom_probe(problems: DataFrame, documents: DataFrame, n: int = 13, items: int | None = None, rate: float = 1e-4) -> DataFrame:
    """``problem_id``, ``hits_bloom``: n-gram places of a problem that a Bloom filter of the corpus holds, and ``fill`` of the filter.

    Never fewer than the exact count; where ``items`` is too small for the
    corpus the filter fills up and reports everything, which ``fill`` shows. The
    set bits are rows, dealt by position. For estimates only: clean sets come
    from the exact audit.
    """
    own = problems.select("problem_id", word_hashes("text").alias("hs")).select("problem_id", F.posexplode(gram_keys("hs", n)).alias("pos", "k")).select("problem_id", "pos", "k.g1", "k.g2")
    grams = corpus_grams(documents, n).select("g1", "g2").distinct()
    bits, k = bloom_size(items or max(1, grams.count()), rate)
    spots = F.array(*[F.pmod(F.col("g1") + F.lit(i) * F.col("g2").cast("bigint"), F.lit(bits)) for i in range(k)])
    on = stage_table(grams.select(F.explode(spots).alias("bit")).distinct(), "bloom")
    fill = on.agg((F.count(F.lit(1)) / bits).alias("fill"))
    asked = own.select("problem_id", "pos", F.explode(F.array_distinct(spots)).alias("bit"), F.size(F.array_distinct(spots)).alias("need"))
    held = asked.join(on, "bit").groupBy("problem_id", "pos").agg(F.count(F.lit(1)).alias("have"), F.max("need").alias("need")).where("have = need")
    per = held.groupBy("problem_id").agg(F.count(F.lit(1)).alias("h"))
    return problems.select("problem_id").join(per, "problem_id", "left").join(F.broadcast(fill)).select("problem_id", F.coalesce("h", F.lit(0)).alias("hits_bloom"), "fill")
