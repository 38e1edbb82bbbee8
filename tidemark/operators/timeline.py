"""Entity timelines over files and overlay: newest copies, deletes, corrections, then the limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import between_points
from tidemark.operators.corrections import latest_versions
from tidemark.streaming.watermarks import merged_ranges

#: Sequence numbers in one cell of a coverage join.
CELL = 1 << 16


def newest_copies(rows: DataFrame, key: tuple[str, ...] = ("epoch", "sequence")) -> DataFrame:
    """One row per point: any file beats the overlay (a null file_id), then the higher generation."""
    order = Window.partitionBy(*key).orderBy(F.col("file_id").isNotNull().desc(), F.col("generation").desc(), F.col("file_id").desc())
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def files_and_overlay(files: DataFrame, overlay: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """The logical events table. With ``coverage`` (tenant_id, epoch, first_sequence,
    last_sequence; one row per file) overlay rows that files cover go first, so that the two sides
    are disjoint; without it newest copies decide."""
    files = files if "file_id" in files.columns else files.withColumn("file_id", F.lit("file"))
    overlay = overlay.withColumn("file_id", F.lit(None).cast(files.schema["file_id"].dataType)) if "file_id" not in overlay.columns else overlay
    if coverage is None:
        return newest_copies(files.unionByName(overlay, allowMissingColumns=True))
    # coverage is cut into cells, so that the join has a key that spreads within an epoch
    covered = merged_ranges(coverage.select("epoch", F.col("first_sequence").alias("first"), F.col("last_sequence").alias("last")))
    covered = covered.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor(F.col("last") / CELL))))
    o, c = overlay.withColumn("_cell", F.floor(F.col("sequence") / CELL)).alias("o"), covered.alias("c")
    fresh = o.join(c, F.expr("o.epoch = c.epoch and o._cell = c._cell and o.sequence between c.first and c.last"), "left_anti")
    return files.unionByName(fresh.drop("_cell"), allowMissingColumns=True)


def timeline(rows: DataFrame, entity: Column, corrections: DataFrame | None = None, deletes: DataFrame | None = None, low: tuple[int, int] | None = None, high: tuple[int, int] | None = None, descending: bool = False, limit: int | None = None, tenant_id: str | None = None) -> DataFrame:
    """The entity's latest versions in point order. The limit counts what is left after newest
    copies, corrections and deletes, and never earlier. Correction rows don't appear at their own
    place. The entity and range filters reach the scan."""
    if tenant_id is not None:
        rows = rows.where(F.col("tenant_id") == tenant_id)
        corrections = corrections.where(F.col("tenant_id") == tenant_id) if corrections is not None and "tenant_id" in corrections.columns else corrections
    mine = rows.where(entity)
    if low or high:
        mine = mine.where(between_points(low or (0, 0), high or (2**62, 2**62)))
    mine = newest_copies(mine) if "generation" in rows.columns else mine
    if corrections is not None:
        mine = latest_versions(mine, corrections, rows, deletes)
    elif deletes is not None:
        mine = without_deleted(mine, deletes)
    point = [F.col(c).desc() if descending else F.col(c).asc() for c in ("epoch", "sequence")]
    out = mine.orderBy(*point)
    return out if limit is None else out.limit(limit)


def without_deleted(rows: DataFrame, deletes: DataFrame, key: tuple[str, ...] = ("file_id", "row_ordinal")) -> DataFrame:
    """Rows that no deletion vector marks; overlay rows have no file and are never marked."""
    return rows.join(deletes.select(*key), list(key), "left_anti")


def late_events(rows: DataFrame, occurred: tuple[int, int]) -> DataFrame:
    """Rows by when they happened, in the order they came in; nothing is too late."""
    return rows.where(F.col("occurred_at").between(*occurred)).orderBy("epoch", "sequence")
