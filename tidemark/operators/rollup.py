"""Time-bucket rollups, and range aggregates that read whole buckets from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import floats
from tidemark.functions.times import MINUTE, bucket


def rollup(df: DataFrame, columns: list[str], width: int = MINUTE, by: list[str] = ()) -> DataFrame:
    """bucket, column and the float summary of every bucket that has a value."""
    wide = df.select(*by, bucket("occurred_at", width).alias("bucket"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in columns])).alias("s")).select(*by, "bucket", "s.column", "s._v")
    return wide.where("_v is not null").groupBy(*by, "bucket", "column").agg(*floats.summary("_v"))


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """Summaries of summaries, for rollups of rollups and of several files."""
    return parts.groupBy(*by).agg(*floats.merged())


def range_aggregate(rows: DataFrame, rolled: DataFrame, column: str, start: int, stop: int, width: int = MINUTE) -> DataFrame:
    """The float summary of ``column`` over [start, stop): buckets that lie inside come from the
    rollup, the rows of the cut buckets at both ends from the table. Equals the full scan."""
    if width <= 0:
        raise ValueError("the width must be positive")
    first, last = -(-start // width), stop // width  # whole buckets: first .. last - 1
    whole = rolled.where((F.col("column") == column) & F.col("bucket").between(first, last - 1)).select("count", "sum", "min", "max")
    at = F.col("occurred_at")
    cut = (at >= start) & (at < stop)
    if first < last:
        cut = cut & ((at < first * width) | (at >= last * width))
    edges = rows.where(cut).select(F.col(column).cast("double").alias("_v")).where("_v is not null").agg(*floats.summary("_v"))
    return whole.unionByName(edges).agg(*floats.merged())


def scan_aggregate(rows: DataFrame, column: str, start: int, stop: int) -> DataFrame:
    """The same answer from all rows of the range."""
    return rows.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < stop)).select(F.col(column).cast("double").alias("_v")).agg(*floats.summary("_v"))


def can_answer_exact(start: int, stop: int, width: int, filtered: bool = False, profile: str = "time_series") -> bool:
    """Whether a rollup alone answers: whole buckets, no other filter, a table that has rollups."""
    return profile == "time_series" and not filtered and width > 0 and start % width == 0 and stop % width == 0


def answer(rows: DataFrame, rolled: DataFrame | None, column: str, start: int, stop: int, width: int = MINUTE) -> DataFrame:
    """The shortcut where it is exact, the cut range or the scan elsewhere."""
    if rolled is None:
        return scan_aggregate(rows, column, start, stop)
    if can_answer_exact(start, stop, width):
        return rolled.where((F.col("column") == column) & F.col("bucket").between(start // width, stop // width - 1)).agg(*floats.merged())
    return range_aggregate(rows, rolled, column, start, stop, width)
