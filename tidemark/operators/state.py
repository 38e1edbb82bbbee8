"""Versioned state: key (type_id, state_key_id) to the event that set it, at any point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["type_id", "state_key_id"]


def state_at(deltas: DataFrame, sn: int, by: list[str] = ()) -> DataFrame:
    """The state as of ``sn``: the last delta of each key; one that removes the key (a null value)
    takes it out. ``deltas``: key columns, sn, value."""
    last = deltas.where(F.col("sn") <= sn).groupBy(*by, *KEY).agg(F.max_by(F.struct("value"), "sn").alias("l"))
    return last.select(*by, *KEY, F.col("l.value").alias("value")).where("value is not null")


def state_get(deltas: DataFrame, sn: int, type_id: str, state_key_id: str) -> DataFrame:
    return state_at(deltas.where((F.col("type_id") == type_id) & (F.col("state_key_id") == state_key_id)), sn)


def state_diff(deltas: DataFrame, old: int, new: int) -> DataFrame:
    """Keys whose value differs between two points, in key order; a missing side is null. Only
    deltas up to the later point are read, once."""
    side = lambda s, name: F.max_by(F.when(F.col("sn") <= s, F.struct("value")), F.when(F.col("sn") <= s, F.col("sn")))["value"].alias(name)
    both = deltas.where(F.col("sn") <= max(old, new)).groupBy(*KEY).agg(side(old, "old_value"), side(new, "new_value"))
    return both.where("not (old_value <=> new_value)").orderBy(*KEY)


def diff_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same of two states at hand."""
    joined = a.withColumnRenamed("value", "old_value").join(b.withColumnRenamed("value", "new_value"), KEY, "full")
    return joined.where("not (old_value <=> new_value)").orderBy(*KEY)


def updated(state: DataFrame, changes: DataFrame) -> DataFrame:
    """A state after ``changes`` (key, sn, value): a value sets, null removes, the last change of a
    key counts."""
    last = changes.groupBy(*KEY).agg(F.max_by(F.struct("value"), "sn").alias("l")).select(*KEY, F.col("l.value").alias("_new"))
    kept = state.join(last.select(*KEY), KEY, "left_anti")
    return kept.unionByName(last.where("_new is not null").select(*KEY, F.col("_new").alias("value")))


def state_digest(state: DataFrame) -> DataFrame:
    """One value that equal states share, whatever built them."""
    return state.agg(F.sum(F.xxhash64(*KEY, "value").cast("decimal(38,0)")).alias("digest"), F.count("*").alias("n"))
