"""Typed predicates. A null never matches, whatever the predicate; floats compare by IEEE rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Bound:
    value: object
    inclusive: bool = True


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def equals(c: Column | str, value) -> Column:
    """Strings by bytes, integers and decimals by value."""
    return F.coalesce(_col(c) == F.lit(value), F.lit(False))


def not_equals(c: Column | str, value) -> Column:
    return F.coalesce(_col(c) != F.lit(value), F.lit(False))


def is_in(c: Column | str, values: list) -> Column:
    return F.coalesce(_col(c).isin(*values), F.lit(False)) if values else F.lit(False)


def in_range(c: Column | str, low: Bound | None = None, high: Bound | None = None) -> Column:
    """Either end may be open; without ends every present value matches."""
    c = _col(c)
    parts = [c.isNotNull()]
    if low is not None:
        parts.append(c >= F.lit(low.value) if low.inclusive else c > F.lit(low.value))
    if high is not None:
        parts.append(c <= F.lit(high.value) if high.inclusive else c < F.lit(high.value))
    return F.coalesce(reduce(Column.__and__, parts), F.lit(False))


def contains_all(c: Column | str, needles: list[str], ignore_ascii_case: bool = False) -> Column:
    """Every needle occurs. No needles, or only empty ones, match every present value."""
    c = _col(c)
    if ignore_ascii_case:
        c = F.translate(c, _UPPER, _LOWER)
        table = str.maketrans(_UPPER, _LOWER)
        needles = [n.translate(table) for n in needles]
    return F.coalesce(reduce(Column.__and__, [F.contains(c, F.lit(n)) for n in needles if n], c.isNotNull()), F.lit(False))


def float_equals(c: Column | str, value: float) -> Column:
    """NaN equals nothing; -0.0 equals 0.0."""
    return F.lit(False) if value != value else F.coalesce(~F.isnan(_col(c)) & (_col(c) == F.lit(value)), F.lit(False))


def float_not_equals(c: Column | str, value: float) -> Column:
    """NaN differs from everything, and everything from NaN."""
    c = _col(c)
    if value != value:
        return c.isNotNull()
    return F.coalesce(F.isnan(c) | (c != F.lit(value)), F.lit(False)) & c.isNotNull()


def float_in(c: Column | str, values: list[float]) -> Column:
    return reduce(Column.__or__, [float_equals(c, v) for v in values], F.lit(False))


def float_range(c: Column | str, low: Bound | None = None, high: Bound | None = None) -> Column:
    """NaN fails every bound and passes a range without bounds."""
    c = _col(c)
    if low is None and high is None:
        return c.isNotNull()
    if any(b is not None and b.value != b.value for b in (low, high)):
        return F.lit(False)
    return in_range(c, low, high) & F.coalesce(~F.isnan(c), F.lit(False))


def numeric_on_other_kind(c: Column | str) -> Column:
    """A numeric predicate asked of a column of another kind matches no row."""
    return F.lit(False)


def between_points(low: tuple[int, int], high: tuple[int, int], epoch: str = "epoch", sequence: str = "sequence") -> Column:
    """Inclusive range of (epoch, sequence) points; the epoch dominates."""
    point = F.struct(F.col(epoch).cast("long"), F.col(sequence).cast("long"))
    at = lambda p: F.struct(F.lit(p[0]).cast("long"), F.lit(p[1]).cast("long"))
    # the plain epoch bounds reach the scan, the exact order is kept above it
    return F.col(epoch).between(low[0], high[0]) & (point >= at(low)) & (point <= at(high))
