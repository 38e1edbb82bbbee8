"""Tokens and trigrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and ASCII punctuation other than the apostrophe part tokens.
SEPARATORS = r"[\p{IsWhite_Space}\p{Punct}&&[^']]+"


def tokens(c: Column | str) -> Column:
    """Lower-case tokens in order; empty ones are dropped."""
    return F.filter(F.split(F.lower(c), SEPARATORS), lambda t: t != "")


def has_tokens(c: Column | str, wanted: list[str]) -> Column:
    """All wanted tokens are there; none wanted matches every present text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(reduce(Column.__and__, [F.array_contains(tokens(c), w.lower()) for w in wanted], c.isNotNull()), F.lit(False))


def trigrams(c: Column | str) -> Column:
    """All runs of three characters in order; none for shorter strings, null for null."""
    c = F.col(c) if isinstance(c, str) else c
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))  # one pass; taking each by its place would be quadratic
    from_ = lambda k: F.slice(chars, k, F.greatest(F.size(chars), F.lit(1)))
    pairs = F.zip_with(chars, from_(2), lambda a, b: F.concat(a, b))
    return F.when(c.isNull(), F.lit(None)).otherwise(F.filter(F.zip_with(pairs, from_(3), lambda a, b: F.concat(a, b)), lambda t: t.isNotNull()))


def may_contain(grams: Column | str | None, needle: str) -> Column:
    """Whether a block with these trigrams can hold ``needle``: only a missing trigram excludes it.
    Needles under three characters and blocks without trigrams are always kept."""
    if grams is None or len(needle) < 3:
        return F.lit(True)
    grams = F.col(grams) if isinstance(grams, str) else grams
    wanted = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, wanted)), grams)) == 0, F.lit(True))


def search_substring(df, column: str, needle: str):
    """Rows whose ``column`` holds ``needle``; the exact test, which Parquet statistics may help."""
    return df.where(F.coalesce(F.contains(F.col(column), F.lit(needle)), F.lit(False)))
