"""Order along a whole table without a task that holds it: ranges cut at sampled keys, running
maxima over blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys for each range, and in all, that the driver sees.
SAMPLE, MOST_SAMPLED = 50, 500_000


def helper() -> str:
    """The name of a helper column, which no input has."""
    return f"_{uuid.uuid4().hex}"


def range_number(df: DataFrame, order: list[str], n: int) -> Column:
    """How many of n - 1 cuts lie below a row's key, a number from 0 to n - 1. The cuts are literals
    taken once from a bounded sample, so that every evaluation puts a row into the same range."""
    key = F.struct(*order)
    share = min(1.0, min(SAMPLE * n, MOST_SAMPLED) / max(df.count(), 1))
    keys = df.select(key.alias("key"))
    found = (keys if share == 1 else keys.sample(share, seed=1)).orderBy("key").select(F.to_json("key")).collect()
    cuts = [found[i * len(found) // n][0] for i in range(1, n)] if found else []
    if not cuts:
        return F.lit(0)
    kind = keys.schema["key"].dataType.simpleString()
    step = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    texts = lambda values: "[" + ",".join(values) + "]"
    below = lambda values: F.size(F.filter(values, lambda c: c < key))
    passed = below(F.from_json(F.lit(texts(b[-1] for b in blocks)), f"array<{kind}>"))
    inside = below(F.get(F.from_json(F.lit(texts(texts(b) for b in [*blocks, []])), f"array<array<{kind}>>"), passed))
    return passed * step + F.when(passed == len(blocks), len(cuts) - step * len(blocks)).otherwise(inside)


def ranked(df: DataFrame, order: list[str], name: str, n: int | None = None) -> DataFrame:
    """``df`` with ``name``, each row's place from 1 by ``order``: ranges are ordered by themselves
    and start where the ranges before them end. Only the sizes of ranges reach the driver."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = helper()
    parts = df.withColumn(part, range_number(df, order, n))
    sizes = {r[0]: r[1] for r in parts.groupBy(part).count().collect()}
    before = [sum(size for p, size in sizes.items() if p < i) for i in range(n)]
    offset = F.get(F.from_json(F.lit(str(before)), "array<bigint>"), F.col(part))
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return parts.withColumn(name, offset + nth).drop(part)


def blocked(df: DataFrame, by: list[str], at: str, block: int) -> tuple[DataFrame, str]:
    """``df`` with a helper column, the block of ``at``, and its name."""
    name = helper()
    return df.withColumn(name, F.floor(F.col(at) / block)), name


def islands(ranges: DataFrame, by: list[str], run: str, gap: int = 0, block: int = 1 << 20) -> DataFrame:
    """``ranges`` (by, first, last, ...) with ``run``, a number within ``by`` that ranges share which
    overlap, or lie up to ``gap`` apart, in a chain. Only blocks, not ranges, are ordered along an
    epoch; ranges are ordered within a block of ``first``."""
    marked, b = blocked(ranges, by, "first", block)
    reach, new, before = helper(), helper(), helper()
    rows = Window.partitionBy(*by, b).orderBy("first", "last")
    earlier = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    tops = marked.groupBy(*by, b).agg(F.max("last").alias(reach)).select(*by, b, F.max(reach).over(earlier).alias(reach))
    # numbers that are equal in every evaluation: by the order of ranges alone
    joined = _same(marked, tops, [*by, b])
    so_far = F.greatest(F.col(reach), F.max("last").over(rows.rowsBetween(Window.unboundedPreceding, -1)))
    joined = joined.withColumn(new, F.coalesce(F.col("first") > so_far + gap, F.lit(True)).cast("long"))
    counts = joined.groupBy(*by, b).agg(F.sum(new).alias(before)).select(*by, b, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    out = _same(joined.withColumn(new, F.sum(new).over(rows)), counts, [*by, b])
    return out.withColumn(run, F.col(new) + F.col(before)).drop(b, reach, new, before)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys that may be null."""
    renamed = {k: helper() for k in keys}
    b = b.withColumnsRenamed(renamed)
    test = None
    for k, r in renamed.items():
        test = F.col(k).eqNullSafe(F.col(r)) if test is None else test & F.col(k).eqNullSafe(F.col(r))
    return a.join(b, test).drop(*renamed.values())


def before_in_block(df: DataFrame, by: list[str], at: str, value: str | None = None, block: int = 1 << 20) -> tuple[DataFrame, str]:
    """``df`` with a helper column, ``value`` (``at`` itself, or what rises with it) of the row before
    by ``at`` within ``by``, null for the first, and its name. Rows are ordered within blocks; a
    block's first row takes the highest value of the blocks before."""
    value = value or at
    marked, b = blocked(df, by, at, block)
    last, name = helper(), helper()
    earlier = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    tops = marked.groupBy(*by, b).agg(F.max(value).alias(last)).select(*by, b, F.max(last).over(earlier).alias(last))
    rows = Window.partitionBy(*by, b).orderBy(at)
    return _same(marked, tops, [*by, b]).withColumn(name, F.coalesce(F.lag(value).over(rows), F.col(last))).drop(b, last), name
