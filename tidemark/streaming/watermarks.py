"""Watermarks over ranges of sequence numbers, and what they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranges import before_in_block, helper, islands


def merged_ranges(ranges: DataFrame, by: tuple[str, ...] = ("epoch",), block: int = 1 << 20) -> DataFrame:
    """by, first, last: overlapping and adjacent ranges joined. Ranges are ordered in blocks of
    ``block`` numbers, whatever their size; only blocks are ordered along an epoch."""
    run = helper()
    marked = islands(ranges.select(*by, "first", "last"), list(by), run, 1, block)
    return marked.groupBy(*by, run).agg(F.min("first").alias("first"), F.max("last").alias("last")).drop(run)


def commit_watermark(ranges: DataFrame, by: tuple[str, ...] = ("epoch",), start: int = 1) -> DataFrame:
    """by, watermark: the last sequence whose whole prefix from the epoch's start is there, events
    or voids alike; null if the start is missing."""
    runs = merged_ranges(ranges, by)
    return runs.groupBy(*by).agg(F.max(F.when(F.col("first") <= start, F.col("last"))).alias("watermark"))


def watermark_of_rows(rows: DataFrame, by: tuple[str, ...] = ("epoch",), start: int = 1, block: int = 1 << 16) -> DataFrame:
    """The same from single rows."""
    points = rows.select(*by, F.col("sequence").alias("first")).distinct().withColumn("last", F.col("first"))
    return commit_watermark(merged_ranges(points, by, block), by, start)


def voids(ranges: DataFrame, sealed: DataFrame, start: int = 1) -> DataFrame:
    """epoch, first, last of the gaps that sealing an epoch turns into void coverage: all between
    its start and its last durable sequence. Then that is the watermark."""
    runs = merged_ranges(ranges.join(sealed.select("epoch"), "epoch", "left_semi"))
    marked, before = before_in_block(runs, ["epoch"], "first", "last")
    low = F.coalesce(F.col(before), F.lit(start - 1))
    return marked.where(F.col("first") > low + 1).select("epoch", (low + 1).alias("first"), (F.col("first") - 1).alias("last"))


def covers(ranges: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (epoch, first, last) with covered: one merged range holds it whole."""
    a, r = asked.alias("a"), merged_ranges(ranges).alias("r")
    hit = a.join(r, F.expr("a.epoch = r.epoch and r.first <= a.first and r.last >= a.last"), "left_semi").withColumn("covered", F.lit(True))
    keys = ["epoch", "first", "last"]
    return asked.join(hit.select(*keys, "covered").distinct(), keys, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def missing(ranges: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked ranges that a live read must wait for; none means it is ready."""
    return covers(ranges, asked).where("not covered").drop("covered")


def evictable(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Overlay segments (tenant_id, epoch, first, last) that one file covers whole."""
    s, f = segments.alias("s"), files.alias("f")
    return s.join(f, F.expr("s.tenant_id = f.tenant_id and s.epoch = f.epoch and f.first <= s.first and f.last >= s.last"), "left_semi")


def kept_segments(segments: DataFrame, files: DataFrame) -> DataFrame:
    s, f = segments.alias("s"), files.alias("f")
    return s.join(f, F.expr("s.tenant_id = f.tenant_id and s.epoch = f.epoch and f.first <= s.first and f.last >= s.last"), "left_anti")


def live_read(segments: DataFrame, ranges: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ready, wait) for ``asked`` (epoch, first, last): where ``ranges`` cover an asked range whole,
    the overlay segments (epoch, first, last, ...) that it touches, each with asked_first and
    asked_last; the asked ranges that aren't covered must be waited for."""
    judged = covers(ranges, asked)
    keys = judged.where("covered").select(F.col("epoch").alias("asked_epoch"), F.col("first").alias("asked_first"), F.col("last").alias("asked_last"))
    touched = segments.join(keys, (F.col("epoch") == F.col("asked_epoch")) & (F.col("first") <= F.col("asked_last")) & (F.col("last") >= F.col("asked_first")))
    return touched.drop("asked_epoch"), judged.where("not covered").drop("covered")


def arbitrated(frames: DataFrame, block: int = 1 << 20) -> DataFrame:
    """The frames (position, tenant_id, epoch, first, last, ...) that replay accepts: in durable
    order, one that overlaps any accepted frame of its tenant and epoch is rejected whole. A frame's
    fate hangs on those of frames that it is chained to by overlaps: such clusters are settled one
    by one, and a frame that overlaps none is accepted without."""
    from bisect import bisect_right

    import pandas as pd

    run, size = helper(), helper()
    by = ["tenant_id", "epoch"]
    marked = islands(frames, by, run, 0, block)
    sizes = marked.groupBy(*by, run).agg(F.count("*").alias(size))
    marked = marked.join(sizes, [*by, run])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        firsts: list[int] = []
        lasts: list[int] = []
        keep = []
        ordered = pdf.sort_values("position")
        for first, last in zip(ordered["first"], ordered["last"]):
            i = bisect_right(firsts, last)
            ok = i == 0 or lasts[i - 1] < first
            if ok:
                firsts.insert(i, first)
                lasts.insert(i, last)
            keep.append(ok)
        return ordered[keep].drop(columns=run)

    contested = marked.where(F.col(size) > 1).select(*frames.columns, run).groupBy(*by, run).applyInPandas(settle, frames.schema)
    return marked.where(F.col(size) == 1).select(*frames.columns).unionByName(contested)


def expired_leases(leases: DataFrame, now: int) -> DataFrame:
    """Reserved ranges whose lease ran out unused: they become void coverage."""
    return leases.where((F.col("expires_at") <= now) & ~F.col("used")).select("epoch", "first", "last")
