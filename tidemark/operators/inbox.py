"""Inboxes: what a recipient hasn't acknowledged yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unread(rows: DataFrame, acks: DataFrame, tenant_id: str, recipient: str | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """The tenant's rows above each recipient's acknowledged point (rows without one are all
    unread), not deleted, in order."""
    mine = rows.where(F.col("tenant_id") == tenant_id)
    if recipient is not None:
        mine = mine.where(F.col("recipient") == recipient)
    if deletes is not None:
        mine = mine.join(deletes.select("file_id", "row_ordinal"), ["file_id", "row_ordinal"], "left_anti")
    known = acks.where(F.col("tenant_id") == tenant_id).select("recipient", F.struct(F.col("ack_epoch").alias("e"), F.col("ack_sequence").alias("s")).alias("_ack"))
    point = F.struct(F.col("epoch").alias("e"), F.col("sequence").alias("s"))
    return mine.join(known, "recipient", "left").where(F.col("_ack").isNull() | (point > F.col("_ack"))).drop("_ack").select(*rows.columns).orderBy("recipient", "epoch", "sequence")


def fully_acked(rows: DataFrame, acks: DataFrame) -> DataFrame:
    """file_id, done: every recipient's newest row lies at or under its acknowledged point. A file
    with rows without recipient has no directory and is never done."""
    newest = rows.groupBy("file_id", "recipient").agg(F.max(F.struct(F.col("epoch").alias("e"), F.col("sequence").alias("s"))).alias("p"))
    known = acks.select("recipient", F.struct(F.col("ack_epoch").alias("e"), F.col("ack_sequence").alias("s")).alias("a"))
    done = F.coalesce(F.col("p") <= F.col("a"), F.lit(False)) & F.col("recipient").isNotNull()
    return newest.join(known, "recipient", "left").groupBy("file_id").agg(F.bool_and(done).alias("done"))
