"""Pruning by statistics: which granules a conjunction of clauses can't match.

A clause is (column, kind, low, high): kind 'eq', 'in', 'range', 'null' or 'not_null'; for 'in' low
is a list. Pruning never decides a row; the residual filter stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an index of each kind that is built here can answer, and whether exactly.
EQUALITY, MEMBERSHIP, RANGE = "equality", "membership", "range"
_POINT = {EQUALITY, MEMBERSHIP}
INDEX_KINDS = {
    "min_max": ({EQUALITY, RANGE}, True),
    "sequence_range": ({RANGE}, True),
    "time_range": ({RANGE}, True),
    "range_filter": ({RANGE}, False),
    "split_block_bloom_filter": (_POINT, False),
    "text_token": (_POINT, False),
    "path_presence": ({EQUALITY}, False),
}
LOW_CARDINALITY, HIGH_RATIO = 256, 10
#: Granules that a scan is given as a list.
MOST_LISTED = 1000


def choose_index(shape: str, available: list[str]) -> str | None:
    """The first index that answers the shape, an exact one before inexact ones."""
    fit = [k for k in available if shape in INDEX_KINDS.get(k, ((), False))[0]]
    return next((k for k in fit if INDEX_KINDS[k][1]), fit[0] if fit else None)


def recommend_filter(distinct: int, rows: int, fixed_keys: bool) -> str:
    """A membership filter pays for at least 256 distinct values that are at least 10 % of the rows."""
    if rows and distinct >= LOW_CARDINALITY and distinct * 100 >= rows * HIGH_RATIO:
        return "binary_fuse" if fixed_keys else "split_block_bloom"
    return "bitmap_or_value_set"


def bloom_options(columns: dict[str, int]) -> dict[str, str]:
    """Parquet writer options that give columns Bloom filters for so many distinct values."""
    return {k: v for c, n in columns.items() for k, v in ((f"parquet.bloom.filter.enabled#{c}", "true"), (f"parquet.bloom.filter.expected.ndv#{c}", str(n)))}


def granule_stats(df: DataFrame, columns: list[str], by: str = "granule_id") -> DataFrame:
    """One wide row per granule: row_count and, per column, min, max and null_count."""
    aggs = [F.count("*").alias("row_count")]
    for c in columns:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}")]
    return df.groupBy(by).agg(*aggs)


def _absent(clause: tuple, have: set[str]) -> Column:
    """Whether statistics prove that no row of the granule satisfies the clause."""
    column, kind, low, high = clause
    if f"min_{column}" not in have:
        return F.lit(False)
    least, most, nulls, rows = F.col(f"min_{column}"), F.col(f"max_{column}"), F.col(f"nulls_{column}"), F.col("row_count")
    if kind == "null":
        proof = nulls == 0
    elif kind == "not_null":
        proof = nulls == rows
    elif kind == "eq":
        proof = (nulls == rows) | (F.lit(low) < least) | (F.lit(low) > most)
    elif kind == "in":
        outside = reduce(Column.__and__, [(F.lit(v) < least) | (F.lit(v) > most) for v in low], F.lit(True))
        proof = (nulls == rows) | outside
    else:
        if low is not None and high is not None and low > high:
            return F.lit(True)  # an inverted range holds nothing
        proof = nulls == rows
        proof = proof | (most < F.lit(low)) if low is not None else proof
        proof = proof | (least > F.lit(high)) if high is not None else proof
    return F.coalesce(proof, F.lit(False))


def evaluate(stats: DataFrame, clauses: list[tuple]) -> DataFrame:
    """``stats`` with keep and residual_required. A granule goes only if some clause is proven
    absent; missing statistics keep it. The residual is always required."""
    drop = reduce(Column.__or__, [_absent(c, set(stats.columns)) for c in clauses], F.lit(False))
    return stats.withColumn("keep", ~drop).withColumn("residual_required", F.lit(True))


def clause_filter(clauses: list[tuple]) -> Column:
    """The residual filter itself."""
    out = F.lit(True)
    for column, kind, low, high in clauses:
        c = F.col(column)
        if kind == "null":
            test = c.isNull()
        elif kind == "not_null":
            test = c.isNotNull()
        elif kind == "eq":
            test = c == F.lit(low)
        elif kind == "in":
            test = c.isin(*low)
        else:
            test = c.isNotNull()
            test = test & (c >= F.lit(low)) if low is not None else test
            test = test & (c <= F.lit(high)) if high is not None else test
        out = out & F.coalesce(test, F.lit(False))
    return out


def pruned_scan(df: DataFrame, stats: DataFrame, clauses: list[tuple], by: str = "granule_id") -> DataFrame:
    """The rows that satisfy all clauses, from kept granules alone; equals the plain filter. A short
    list of granules becomes a filter of the scan, which then skips row groups and pages; a long one
    is joined."""
    kept = evaluate(stats, clauses).where("keep").select(by)
    ids = [r[0] for r in kept.limit(MOST_LISTED + 1).collect()]
    rows = df.where(clause_filter(clauses))
    return rows.where(F.col(by).isin(ids)) if len(ids) <= MOST_LISTED else rows.join(kept, by, "left_semi")
