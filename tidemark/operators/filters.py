"""Skip filters of granules beyond minima and maxima, and the sidecar table that holds them.

A filter is a bitmap of 32,768 bits: hashes of a granule's values (tokens, payload paths, keys) or
the numbers of the value buckets that it has rows in. A clear bit proves absence, a set bit nothing,
so a filter only ever skips granules and the residual test stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 1 << 15
MEMBERSHIP, RANGE = ("text_token", "path_presence", "split_block_bloom_filter"), "range_filter"


def value_hash(value: Column | str) -> Column:
    """The bit of a token, a path or a key."""
    return F.pmod(F.xxhash64(value), F.lit(BITS)).cast("int")


def _bitmap(rows: DataFrame, bit: Column, by: str) -> DataFrame:
    # Spark's bitmaps count positions from 1
    return rows.groupBy(by).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit.cast("long") + 1)).alias("bits"))


def membership_filter(df: DataFrame, values: Column, kind: str, column: str, by: str = "granule_id") -> DataFrame:
    """granule, kind, column, width, bits of the arrays ``values``."""
    if kind not in MEMBERSHIP:
        raise ValueError(f"unknown membership filter {kind}")
    rows = df.select(by, F.explode(values).alias("value")).where("value is not null")
    return _bitmap(rows, value_hash("value"), by).select(F.col(by).alias("granule"), F.lit(kind).alias("kind"), F.lit(column).alias("column"), F.lit(None).cast("long").alias("width"), "bits")


def range_filter(df: DataFrame, column: str, width: int, by: str = "granule_id") -> DataFrame:
    """The same over buckets of ``width`` of an integer column."""
    rows = df.where(F.col(column).isNotNull()).select(by, F.pmod(F.floor(F.col(column) / width), F.lit(BITS)).alias("bucket"))
    return _bitmap(rows, F.col("bucket"), by).select(F.col(by).alias("granule"), F.lit(RANGE).alias("kind"), F.lit(column).alias("column"), F.lit(width).cast("long").alias("width"), "bits")


def has_bit(bits: Column | str, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*[byte.bitwiseAND(1 << k) != 0 for k in range(8)]), (position % 8).cast("int"))


def lacks_any(wanted: list[str]) -> Column:
    """Whether a membership filter proves that a granule lacks one of the wanted values."""
    return reduce(Column.__or__, [~has_bit("bits", value_hash(F.lit(w))) for w in wanted], F.lit(False))


def lacks_range(low: int, high: int) -> Column:
    """Whether a range filter proves that a granule has no value in [low, high]."""
    first, last = F.floor(F.lit(low) / F.col("width")), F.floor(F.lit(high) / F.col("width"))
    buckets = F.sequence(first, F.greatest(F.least(last, first + BITS), first))
    empty = ~F.exists(buckets, lambda b: has_bit("bits", F.pmod(b, F.lit(BITS))))
    return F.when(last < first, F.lit(True)).when(last - first >= BITS, F.lit(False)).otherwise(empty)


def state_of(df: DataFrame, columns: list[str], by: str = "granule_id") -> DataFrame:
    """granule, state: a digest of a granule's rows, whatever their order. An artifact carries that of
    the rows it was made from."""
    row = F.xxhash64(*columns)
    return df.groupBy(F.col(by).alias("granule")).agg(F.concat_ws("-", F.count("*"), F.sum(row.cast("decimal(38,0)"))).alias("state"))


def write_sidecar(filters: DataFrame, states: DataFrame, path: str) -> None:
    """Artifacts beside a table: one row per granule, kind and column, with the granule's state."""
    filters.join(states, "granule").write.mode("overwrite").partitionBy("kind").parquet(path)


def usable(spark: SparkSession, path: str, states: DataFrame) -> DataFrame:
    """The artifacts whose granules are still what they were made from; others are passed over."""
    return spark.read.parquet(path).join(states, ["granule", "state"], "left_semi").drop("state")


def skipped(artifacts: DataFrame, kind: str, column: str, lacks: Column) -> DataFrame:
    """granule of those that a filter rules out."""
    return artifacts.where((F.col("kind") == kind) & (F.col("column") == column) & lacks).select("granule")


def filtered_scan(df: DataFrame, gone: DataFrame, residual: Column, by: str = "granule_id") -> DataFrame:
    """The rows that pass ``residual``, from granules that no filter rules out."""
    return df.where(residual).join(gone.withColumnRenamed("granule", by), by, "left_anti")
