"""Row sets: exact set algebra, rank and select, and answers from statistics alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import helper, islands
from tidemark.operators.ranges import ranked as place_by


def intersect(a: DataFrame, b: DataFrame, key: str = "row_ordinal") -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def difference(a: DataFrame, b: DataFrame, key: str = "row_ordinal") -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def carrying_all(df: DataFrame, column: str, values: list, key: str = "row_ordinal") -> DataFrame:
    """Rows that carry every one of the values, where a row has a line per value; no values or an
    unknown one give no row."""
    wanted = list(dict.fromkeys(values))
    if not wanted:
        return df.select(key).limit(0)
    return df.where(F.col(column).isin(*wanted)).groupBy(key).agg(F.count_distinct(column).alias("_n")).where(F.col("_n") == len(wanted)).select(key)


def cardinality(df: DataFrame, key: str = "row_ordinal") -> DataFrame:
    """The number of distinct rows, by bitmaps of 32,768 rows that merge across tasks."""
    parts = df.groupBy(F.bitmap_bucket_number(key).alias("_bucket")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(key))).alias("n"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def runs(df: DataFrame, key: str = "row_ordinal", block: int = 1 << 20) -> DataFrame:
    """Maximal runs first..last of consecutive rows. Runs are built per block of rows and joined
    where blocks meet, so that no task orders all rows."""
    points = df.select(F.col(key).alias("first")).distinct().withColumn("last", F.col("first"))
    run = helper()
    return islands(points, [], run, 1, block).groupBy(run).agg(F.min("first").alias("first"), F.max("last").alias("last")).drop(run)


def ranked(df: DataFrame, flag: Column, by: str = "row_ordinal", block: int = 8192) -> DataFrame:
    """``df`` with rank, the flagged rows strictly before each row, and select, the number from 0
    of each flagged row. Counts per block come first, so blocks are ranked side by side."""
    df = df.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("long")).withColumn("_block", F.floor(F.col(by) / block))
    sums = df.groupBy("_block").agg(F.sum("_flag").alias("_n"))
    before = sums.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("_flag").over(Window.partitionBy("_block").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("_within", within).join(before, "_block").withColumn("rank", F.col("_within") + F.col("_before"))
    return out.withColumn("select", F.when(F.col("_flag") == 1, F.col("rank"))).drop("_flag", "_block", "_within", "_before")


def block_stats(df: DataFrame, columns: list[str], by: str = "granule_id") -> DataFrame:
    """granule_id, column, min, max (as strings that keep numbers' text), null_count, row_count and,
    for a constant block, its value."""
    aggs = [F.count("*").alias("_rows")]
    for c in columns:
        aggs += [F.min(c).cast("string").alias(f"_min_{c}"), F.max(c).cast("string").alias(f"_max_{c}"), F.count_if(F.col(c).isNull()).alias(f"_null_{c}")]
    wide = df.groupBy(by).agg(*aggs)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_min_{c}").alias("min"), F.col(f"_max_{c}").alias("max"), F.col(f"_null_{c}").alias("null_count")) for c in columns]))
    return wide.select(by, F.col("_rows").alias("row_count"), cells.alias("s")).select(by, "s.column", "s.min", "s.max", "s.null_count", "row_count")


def metadata_answer(value: str) -> Column:
    """What statistics alone say of ``column = value``: all rows, no rows, or decode."""
    constant = (F.col("null_count") == 0) & (F.col("min") == F.col("max"))
    return (
        F.when(F.col("null_count") == F.col("row_count"), "NoRowsMatch")
        .when(constant & (F.col("min") == value), "AllRowsMatch")
        .when(constant, "NoRowsMatch")
        .otherwise("MustDecode")
    )


def string_bounds(c: str, width: int = 32) -> list[Column]:
    """Bounded string statistics: the lower bound cut down, the upper rounded up, and whether both
    are exact. An upper bound that can't be rounded up within the width is null, unbounded."""
    low, high = F.min(c), F.max(c)
    cut = F.substring(high, 1, width)
    up = F.when(F.length(high) <= width, high).otherwise(F.concat(F.substring(cut, 1, width - 1), F.chr(F.ascii(F.substring(cut, width, 1)) + 1)))
    up = F.when((F.length(high) > width) & (F.ascii(F.substring(cut, width, 1)) >= 126), F.lit(None)).otherwise(up)
    return [F.substring(low, 1, width).alias("low"), up.alias("high"), ((F.length(low) <= width) & (F.length(high) <= width)).alias("exact")]


def global_dictionary(df: DataFrame, column: str) -> DataFrame:
    """value, code: codes from 0 in byte order of the distinct values, which are ordered by ranges."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    return place_by(values, ["value"], "code").withColumn("code", F.col("code") - 1)


def encoded(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """``df`` with the codes of a column; a predicate on values becomes one on codes."""
    return df.join(dictionary.withColumnRenamed("value", column).withColumnRenamed("code", f"{column}_code"), column, "left")


def clustered(df: DataFrame, bucket: Column, order: str = "sequence", block: int = 8192) -> DataFrame:
    """bucket, islands: into how many runs each bucket falls along ``order``; a clustered table has
    one run each."""
    df = df.select(F.col(order).alias("_o"), bucket.alias("bucket")).withColumn("_block", F.floor(F.col("_o") / block))
    w = Window.partitionBy("_block").orderBy("_o")
    starts = df.withColumn("_new", F.coalesce(F.col("bucket") != F.lag("bucket").over(w), F.lit(True))).withColumn("_edge", F.row_number().over(w) == 1)
    # a block's first run goes on from the block before if that ended in the same bucket
    ends = df.groupBy("_block").agg(F.max_by("bucket", "_o").alias("_last")).withColumn("_before", F.lag("_last").over(Window.orderBy("_block"))).drop("_last")
    counted = starts.where("_new").join(ends, "_block").where("not (_edge and bucket <=> _before)")
    return counted.groupBy("bucket").agg(F.count("*").alias("islands"))


def first_at_least(df: DataFrame, column: str, key) -> DataFrame:
    """The first row whose sorted column reaches ``key``."""
    return df.where(F.col(column) >= F.lit(key)).agg(F.min("row_ordinal").alias("row_ordinal"))
