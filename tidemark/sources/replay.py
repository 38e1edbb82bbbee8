"""Replay of durable frames: what a torn or altered tail leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_hash(payload: str = "payload"):
    return F.sha2(F.coalesce(F.col(payload), F.lit("")).cast("binary"), 256)


def replayed(frames: DataFrame) -> DataFrame:
    """The frames (segment, position, payload, hash, previous) of each segment up to the first that
    doesn't hold: its payload gives another hash, it doesn't name the hash before it, or a position
    is missing. A segment is a bounded run of frames and is ordered by itself."""
    w = Window.partitionBy("segment").orderBy("position")
    linked = F.col("previous").eqNullSafe(F.lag("hash").over(w)) | (F.row_number().over(w) == 1)
    dense = F.coalesce(F.col("position") == F.lag("position").over(w) + 1, F.lit(True))
    broken = frames.withColumn("_bad", ~((frame_hash() == F.col("hash")) & linked & dense))
    first = F.min(F.when(F.col("_bad"), F.col("position"))).over(Window.partitionBy("segment"))
    return broken.withColumn("_first", first).where("_first is null or position < _first").drop("_bad", "_first")


def tails(frames: DataFrame) -> DataFrame:
    """segment, kept, torn: frames that replay, and whether more followed them."""
    kept = replayed(frames).groupBy("segment").agg(F.count("*").alias("kept"))
    every = frames.groupBy("segment").agg(F.count("*").alias("n"))
    return every.join(kept, "segment", "left").select("segment", F.coalesce("kept", F.lit(0)).alias("kept"), (F.coalesce("kept", F.lit(0)) < F.col("n")).alias("torn"))
