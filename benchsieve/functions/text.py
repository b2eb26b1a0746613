"""Normalisation, tokens and n-grams as column expressions, with their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; what ``\\s`` means differs between engines.
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]+"
WS_SQL = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
COMMANDS = r"\\[a-zA-Z]+|[{}$]"


def normalize(c: str | Column, strip_markup: bool = True) -> Column:
    """Lower case, TeX commands, braces and dollar signs as spaces, white space collapsed; or only the last."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.coalesce(c, F.lit(""))
    if strip_markup:
        c = F.regexp_replace(F.lower(c), COMMANDS, " ")
    return F.trim(F.regexp_replace(c, WS, " "))


def tokens(c: str | Column, strip_markup: bool = True) -> Column:
    """The words of a normalized text; none for an empty one."""
    return F.filter(F.split(normalize(c, strip_markup), " "), lambda w: w != "")


def gram_count(toks: str | Column, n: int) -> Column:
    """How many n-grams there are, repeats included."""
    return F.greatest(F.size(toks) - F.lit(n - 1), F.lit(0)).cast("bigint")


def word_hashes(c: str | Column, strip_markup: bool = True) -> Column:
    """The words of a normalized text as hashes. Give it a column of its own before ``gram_keys`` reads it."""
    return F.transform(tokens(c, strip_markup), lambda w: F.xxhash64(w))


def gram_keys(hashes: str | Column, n: int) -> Column:
    """Keys of the n-grams in order: two hashes of each, 96 bits; null if there are none.

    The keys stand for the n-gram strings in joins and counts: building and
    shuffling the strings would cost n times the text. The n word hashes are
    read one by one, since taking a slice copies the whole array each time.
    """
    hashes = F.col(hashes) if isinstance(hashes, str) else hashes

    def key(i: Column) -> Column:
        part = [F.get(hashes, i + j) for j in range(n)]
        return F.struct(F.xxhash64(*part).alias("g1"), F.hash(*part).alias("g2"))

    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(0), F.size(hashes) - F.lit(n)), key))


def gram_text(toks: str | Column, place: str | Column, n: int) -> Column:
    """The n-gram at a place, counted from 1, as its words joined by spaces."""
    return F.array_join(F.slice(toks, place, F.lit(n)), " ")


def normalize_sql(col: str, strip_markup: bool = True) -> str:
    inner = f"regexp_replace(lower(coalesce({col}, '')), '{COMMANDS}', ' ', 'g')" if strip_markup else f"coalesce({col}, '')"
    return f"trim(regexp_replace({inner}, '{WS_SQL}', ' ', 'g'))"


def tokens_sql(col: str, strip_markup: bool = True) -> str:
    return f"list_filter(string_split({normalize_sql(col, strip_markup)}, ' '), lambda w: w <> '')"


def grams_sql(source: str, keys: str, n: int) -> str:
    """A query for ``keys``, ``pos`` (from 0) and ``g`` of every n-gram of ``source``, which has ``keys`` and ``toks``."""
    words = f"SELECT {keys}, unnest(toks) AS w, generate_subscripts(toks, 1) - 1 AS pos FROM {source}"
    ahead = ", ".join(["w", *(f"lead(w, {i}) OVER win" for i in range(1, n))])
    part = ", ".join(k.strip() for k in keys.split(","))
    return f"SELECT {keys}, pos, g FROM (SELECT {keys}, pos, concat_ws(' ', {ahead}) AS g, lead(w, {n - 1}) OVER win AS last FROM ({words}) WINDOW win AS (PARTITION BY {part} ORDER BY pos)) WHERE last IS NOT NULL"
