"""Counts, distinct estimates, sketches and aggregates corrected for deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT_DISTINCT, HLL_ERROR, HLL_BITS = 1024, 0.065, 8


def distinct_estimate(df: DataFrame, columns: list[str], limit: int = EXACT_DISTINCT) -> DataFrame:
    """column, distinct, exact: the exact number up to ``limit``, an estimate beyond. Nulls are no
    values. Sketches decide whether counting exactly is bounded: only values of columns whose
    estimate is near the limit or below are shuffled."""
    from pyspark.sql import Row

    guess = df.agg(*[F.approx_count_distinct(c, HLL_ERROR).alias(c) for c in columns]).first()
    small = [c for c in columns if guess[c] <= limit * (1 + 6 * HLL_ERROR)]
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in small]).first() if small else Row()
    rows = []
    for c in columns:
        ok = c in small and exact[c] <= limit
        rows.append((c, exact[c] if ok else guess[c], ok))
    return df.sparkSession.createDataFrame(rows, "column string, distinct long, exact boolean")


def distinct_sketch(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """A mergeable sketch per group."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.xxhash64(column), HLL_BITS).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """The distinct estimate over the union of sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def summed_distinct(estimates: DataFrame) -> DataFrame:
    """A file's estimate is the sum of its stripes'; it is exact only for one exact stripe."""
    return estimates.agg(F.sum("distinct").alias("distinct"), ((F.count("*") == 1) & F.bool_and("exact")).alias("exact"))


def less_deleted(totals: DataFrame, deleted: DataFrame, value: str | None = None) -> DataFrame:
    """COUNT and SUM without deleted rows, from the totals (count, sum) and the deleted rows alone.
    The count stops at 0; where a deleted value is unknown the sum is null and needs a scan."""
    lost = [F.count("*").alias("_n")]
    if value:
        lost += [F.sum(value).alias("_s"), F.count_if(F.col(value).isNull()).alias("_unknown")]
    gone = deleted.agg(*lost)
    out = totals.crossJoin(gone)  # one row with one row
    count = F.greatest(F.col("count") - F.col("_n"), F.lit(0)).alias("count")
    return out.select(count) if not value else out.select(count, F.when(F.col("_unknown") == 0, F.col("sum") - F.coalesce("_s", F.lit(0.0))).alias("sum"))


def sparse_cube(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts for every combination of columns that occurs, with subtotals (level tells which)."""
    return df.cube(*columns).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def quantiles(df: DataFrame, column: str, fractions: list[float], by: list[str] = ()) -> DataFrame:
    """Approximate quantiles, for queries that ask for approximate answers."""
    return df.groupBy(*by).agg(F.percentile_approx(column, fractions, 10_000).alias("quantiles"))


def frequent(df: DataFrame, column: str, k: int) -> DataFrame:
    """item, count of the approximately most frequent values."""
    return df.agg(F.expr(f"approx_top_k({column}, {int(k)})").alias("t")).select(F.explode("t").alias("t")).select("t.item", "t.count")


def can_answer_approx(asked_approximate: bool) -> bool:
    return asked_approximate


def revenue(amount: Column, by: list[Column], df: DataFrame) -> DataFrame:
    """Exact revenue: decimals, never floats."""
    return df.groupBy(*by).agg(F.sum(amount.cast("decimal(38,4)")).alias("revenue"), F.count("*").alias("n"))
