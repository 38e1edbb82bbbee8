"""The event graph: parents, children, walks, chain labels and validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import before_in_block
from tidemark.sources.shared import written


def parents(edges: DataFrame, asked: DataFrame, kind: str | None = None) -> DataFrame:
    """sn, parents in the writer's order for each asked sn; none gives an empty list."""
    e = edges if kind is None else edges.where(F.col("kind") == kind)
    lists = e.groupBy(F.col("child_sn").alias("sn")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "parent_sn"))), lambda x: x["parent_sn"]).alias("parents"))
    return asked.select("sn").join(lists, "sn", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<bigint>")))


def children(edges: DataFrame, asked: DataFrame, kind: str | None = None) -> DataFrame:
    """sn, children ascending for each asked sn."""
    e = edges if kind is None else edges.where(F.col("kind") == kind)
    lists = e.groupBy(F.col("parent_sn").alias("sn")).agg(F.array_sort(F.collect_set("child_sn")).alias("children"))
    return asked.select("sn").join(lists, "sn", "left").withColumn("children", F.coalesce("children", F.array().cast("array<bigint>")))


def walk(edges: DataFrame, start: list[int], towards: str = "parents", limit: int | None = None, levels: int | None = None) -> DataFrame:
    """sn, level in breadth-first order without the start: level by level, each ascending, every
    event once, cut at ``limit``. One join per level; visited events and frontiers are written to
    the shared folder, so that plans and lost executors cost one level at most."""
    spark = edges.sparkSession
    a, b = ("child_sn", "parent_sn") if towards == "parents" else ("parent_sn", "child_sn")
    hops = edges.select(F.col(a).alias("sn"), F.col(b).alias("to")).distinct()
    frontier = spark.createDataFrame([(s, 0) for s in sorted(set(start))], "sn long, level int")
    seen, level, count = frontier, 0, 0
    while levels is None or level < levels:
        level += 1
        new = hops.join(frontier.select("sn"), "sn").select(F.col("to").alias("sn")).distinct().join(seen, "sn", "left_anti").withColumn("level", F.lit(level))
        frontier = written(new, "levels")
        found = frontier.count()
        seen, count = seen.unionByName(frontier), count + found
        if not found or (limit is not None and count >= limit):
            break
    out = seen.where("level > 0").orderBy("level", "sn")
    return out if limit is None else out.limit(limit)


def chain_labels(labels: DataFrame, asked: DataFrame) -> DataFrame:
    """sn, chain_id, seq of each asked event, null without a label."""
    return asked.select("sn").join(labels.select("sn", "chain_id", "seq"), "sn", "left")


def chain_links(links: DataFrame, chains: DataFrame) -> DataFrame:
    """Distinct links from the asked chains, sorted."""
    keys = ["from_chain", "from_seq", "to_chain", "to_seq"]
    return links.join(chains.select(F.col("chain_id").alias("from_chain")).distinct(), "from_chain").select(*keys).distinct().orderBy(*keys)


def needed_links(links: DataFrame) -> DataFrame:
    """Links without those that a later source and an earlier or equal target make redundant: of
    the links of a chain to another the ones that reach further than every earlier link."""
    w = Window.partitionBy("from_chain", "to_chain").orderBy("from_seq", F.col("to_seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return links.distinct().withColumn("_best", F.max("to_seq").over(w)).where("_best is null or to_seq > _best").drop("_best")


def unresolved(refs: DataFrame, events: DataFrame) -> DataFrame:
    """References (child_sn, parent_id) whose parent isn't known yet."""
    return refs.join(events.select(F.col("event_id").alias("parent_id")), "parent_id", "left_anti")


def faults(events: DataFrame, edges: DataFrame) -> DataFrame:
    """subject, fault, sn of every breach: a gap in the sequence numbers, a parent that isn't
    earlier, an edge named twice, an edge of an unknown event."""
    marked, before = before_in_block(events.select("subject", "sn"), ["subject"], "sn")
    gaps = marked.where(F.col("sn") != F.col(before) + 1).select("subject", F.lit("gap").alias("fault"), "sn")
    late = edges.where("parent_sn >= child_sn").select("subject", F.lit("parent not earlier").alias("fault"), F.col("child_sn").alias("sn"))
    twice = edges.groupBy("subject", "child_sn", "kind", "parent_sn").count().where("count > 1").select("subject", F.lit("edge repeated").alias("fault"), F.col("child_sn").alias("sn"))
    known = events.select("subject", F.col("sn").alias("child_sn"))
    lost = edges.select("subject", "child_sn").distinct().join(known, ["subject", "child_sn"], "left_anti").select("subject", F.lit("unknown event").alias("fault"), F.col("child_sn").alias("sn"))
    return gaps.unionByName(late).unionByName(twice).unionByName(lost)


def resolved_edges(refs: DataFrame, events: DataFrame) -> DataFrame:
    """Edges by sequence number of references by id; those without an event stay out."""
    return refs.join(events.select(F.col("event_id").alias("parent_id"), F.col("sn").alias("parent_sn")), "parent_id").drop("parent_id")
