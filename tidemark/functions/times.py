"""Time in signed nanoseconds. Division rounds down, so times before 1970 fall in the right bucket."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60 * 10**9


def floor_div(x: Column | str, width: int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    if width <= 0:
        raise ValueError("the width must be positive")
    # exact in 64 bits: never through doubles, and down where plain division truncates
    return F.call_function("div", x - F.pmod(x, F.lit(width)), F.lit(width))


def bucket(x: Column | str, width: int = MINUTE) -> Column:
    """The number of the bucket."""
    return floor_div(x, width)


def bucket_start(x: Column | str, width: int = MINUTE) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x - F.pmod(x, F.lit(width))


def seconds(nanos: Column | str) -> Column:
    """Whole seconds of a claimed time."""
    return floor_div(nanos, 10**9)


def nanos_of(ts: str, kind: str = "timestamp") -> Column:
    """Nanoseconds since 1970 of a timestamp column. One without time zone (timestamp_ntz) is taken
    as UTC, whatever the session's zone."""
    if kind != "timestamp_ntz":
        return F.unix_micros(ts) * 1000
    since = f"({ts} - timestamp_ntz'1970-01-01 00:00:00')"
    return F.expr(f"(((extract(DAY FROM {since}) * 24 + extract(HOUR FROM {since})) * 60 + extract(MINUTE FROM {since})) * 60000000L + cast(extract(SECOND FROM {since}) * 1000000 as bigint)) * 1000L")


def timestamp_of(nanos: Column | str) -> Column:
    return F.timestamp_micros(floor_div(nanos, 1000))
