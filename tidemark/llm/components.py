"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """node, component (its component's smallest node) for every node with an edge.

    ``edges``: a, b. Each step keeps one row per edge, takes minima with partial aggregation and
    joins them back by node, so a hub of any degree is split like every skewed join side. Lineage
    is cut after each step by a written table, in one file for each million edges. Steps needed grow
    with the logarithm of the size.
    """
    e = ws.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    seen, step = None, 0
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen, step = now, step + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = ws.stage(small, f"{name}-{step}", 1 + now[0] // 1_000_000)
        ws.drop(f"{name}-{step - 1}")
        e = new
