"""References between events: children, threads, resolution by id space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identifiers import references


def pointing_at(events: DataFrame, column: str, ref: str) -> DataFrame:
    """Events whose reference column names ``ref``; multi-valued columns match whole references."""
    return events.where(F.array_contains(references(column), ref))


def children_of(events: DataFrame, refs: DataFrame, column: str = "parent_ref") -> DataFrame:
    """ref and the columns of every event that names it, for many refs at once."""
    return events.withColumn("ref", F.explode(references(column))).join(refs.select("ref").distinct(), "ref")


def thread(events: DataFrame, root: str) -> DataFrame:
    """All events of a thread; its root is not one of them."""
    return events.where(F.col("root_ref") == root)


def resolve(refs: DataFrame, events: DataFrame, spaces: dict[str, str]) -> DataFrame:
    """``refs`` (ref, as space:id) with the event it names; ``spaces`` maps an id space to the id
    column of ``events``. References that name nothing have a null event."""
    parts = refs.withColumn("_space", F.substring_index("ref", ":", 1)).withColumn("_id", F.expr("substring(ref, instr(ref, ':') + 1)"))
    named = F.explode(F.array(*[F.struct(F.lit(s).alias("_space"), F.col(c).cast("string").alias("_id")) for s, c in spaces.items()]))
    ids = events.select(F.col("event_id").alias("found_event_id"), named.alias("_n")).select("found_event_id", "_n._space", "_n._id").where("_id is not null")
    return parts.join(ids, ["_space", "_id"], "left").drop("_space", "_id")


def sequence_numbers(ids: DataFrame, events: DataFrame, column: str = "event_id") -> DataFrame:
    """ids (place, id) with sn, one answer per id in order of place, null where absent."""
    known = events.groupBy(F.col(column).alias("id")).agg(F.min("sn").alias("sn"))
    return ids.join(known, "id", "left").select("place", "id", "sn").orderBy("place")


def aligned(base: DataFrame, derived: DataFrame) -> DataFrame:
    """A base file and its derived columns, one to one by row."""
    return base.join(derived, ["file_id", "row_ordinal"])


def newest_external(rows: DataFrame) -> DataFrame:
    """external_id, file_id, row_ordinal of its newest row: the highest generation, then the last row."""
    best = F.max_by(F.struct("file_id", "row_ordinal"), F.struct("generation", "row_ordinal", "file_id")).alias("b")
    return rows.where("external_id is not null").groupBy("external_id").agg(best).select("external_id", "b.file_id", "b.row_ordinal")


def all_external(rows: DataFrame, external_id: str) -> DataFrame:
    return rows.where(F.col("external_id") == external_id).orderBy("generation", "row_ordinal")


def overlapping(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: int, by: list[str] = ()) -> DataFrame:
    """Pairs of rows whose inclusive spans overlap, with the columns of both (no name may be in
    both but ``by``). Spans are cut into cells of ``width`` and joined by cell, so that a long list
    on both sides is never a nested loop; each pair is found in the cell of its later start."""
    cell = lambda df, s: df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(s[0]) / width), F.floor(F.col(s[1]) / width))))
    both = cell(a, a_span).join(cell(b, b_span), ["_cell", *by])
    met = (F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(b_span[0]) <= F.col(a_span[1]))
    return both.where(met & (F.col("_cell") == F.floor(F.greatest(a_span[0], b_span[0]) / width))).drop("_cell")
