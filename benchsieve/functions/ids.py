"""Canonical spellings of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def paper_key(c: str | Column) -> Column:
    """``YYMM.NNNNN`` of a paper id in any spelling and version, else null."""
    got = F.regexp_extract(c, r"(?<!\d)(\d{4}\.\d{4,5})(?!\d)", 1)
    return F.when(got != "", got)


def author_key(c: str | Column) -> Column:
    """The number of an author key without leading zeros, else null; placeholders and zero are null."""
    got = F.regexp_extract(F.lower(F.trim(c)), r"^au[-_\s]*0*([1-9]\d*)$", 1)
    return F.when(got != "", got)
