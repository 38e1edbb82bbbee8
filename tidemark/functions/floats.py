"""Aggregates of float columns with IEEE rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _key(c: Column) -> Column:
    """Orders -0.0 below 0.0, which plain minima and maxima take for the same."""
    return F.struct(c.alias("v"), F.when(c.cast("string") == "-0.0", 0).otherwise(1).alias("s"))


def _value(k: Column) -> Column:
    return F.when((k["v"] == 0) & (k["s"] == 0), F.lit(-0.0)).otherwise(k["v"])


def summary(c: str, prefix: str = "", exact_zeros: bool = False) -> list[Column]:
    """count, sum, min and max of a column. The count has NaNs and no nulls; a NaN makes the sum
    NaN; extremes skip NaNs and are NaN if nothing is left; no values give 0, 0.0, NaN, NaN."""
    col = F.col(c)
    real = F.when(~F.isnan(col), col)
    low, high = (_value(F.min(F.when(real.isNotNull(), _key(real)))), _value(F.max(F.when(real.isNotNull(), _key(real))))) if exact_zeros else (F.min(real), F.max(real))
    return [
        F.count(col).alias(f"{prefix}count"),
        F.coalesce(F.sum(col), F.lit(0.0)).alias(f"{prefix}sum"),
        F.coalesce(low, F.lit(NAN)).alias(f"{prefix}min"),
        F.coalesce(high, F.lit(NAN)).alias(f"{prefix}max"),
    ]


def merged(prefix: str = "") -> list[Column]:
    """The summary of several summaries."""
    low, high = F.col(f"{prefix}min"), F.col(f"{prefix}max")
    return [
        F.coalesce(F.sum(f"{prefix}count"), F.lit(0)).alias(f"{prefix}count"),
        F.coalesce(F.sum(f"{prefix}sum"), F.lit(0.0)).alias(f"{prefix}sum"),
        F.coalesce(F.min(F.when(~F.isnan(low), low)), F.lit(NAN)).alias(f"{prefix}min"),
        F.coalesce(F.max(F.when(~F.isnan(high), high)), F.lit(NAN)).alias(f"{prefix}max"),
    ]
