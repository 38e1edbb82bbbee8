"""The manifest: which files are visible, what they cover, and the tables of the system schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of system.files (no keys, paths or payloads), and the six part states
# with the only moves between them.
FILE_COLUMNS = ["created_at", "file_seal", "file_id", "file_size", "generation_id", "granule_count", "row_count"]
STATES = {"open_tmp": "sealed", "sealed": "active", "active": "outdated", "outdated": "delete_on_destroy", "delete_on_destroy": "deleted", "deleted": None}


def can_move(old: str, new: str) -> bool:
    return new is not None and STATES.get(old) == new


def selectable(manifest: DataFrame) -> DataFrame:
    """Only active files are read."""
    return manifest.where("state = 'active'")


def visible(manifest: DataFrame, generation: int) -> DataFrame:
    return selectable(manifest).where(F.col("generation") <= generation)


def system_files(manifest: DataFrame, caller: str, tenant_id: str | None = None) -> DataFrame:
    """Administrators see all files, tenants their own, nobody else any."""
    if caller == "admin":
        return manifest.select(*FILE_COLUMNS)
    if caller == "tenant" and tenant_id is not None:
        return manifest.where(F.col("tenant_id") == tenant_id).select(*FILE_COLUMNS)
    raise PermissionError("system.files is not public")


def system_columns(df: DataFrame) -> DataFrame:
    """name, type, nullable, place of a table's columns."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean, place int")


def system_granules(df: DataFrame) -> DataFrame:
    """Rows and spans of every granule."""
    return df.groupBy("granule_id").agg(F.count("*").alias("row_count"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.min("occurred_at").alias("min_time"), F.max("occurred_at").alias("max_time"))


def system_rewrites(manifest: DataFrame) -> DataFrame:
    """Which file replaced which: an outdated file and the active file that covers its range."""
    old, new = manifest.where("state = 'outdated'").alias("o"), selectable(manifest).alias("n")
    return old.join(new, F.expr("o.tenant_id = n.tenant_id and o.epoch = n.epoch and n.first_sequence <= o.first_sequence and n.last_sequence >= o.last_sequence and n.generation > o.generation")).select(F.col("o.file_id").alias("old_file_id"), F.col("n.file_id").alias("new_file_id"))


def file_summary(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """row_count, spans of sequence and time; per file where ``by`` names its columns."""
    spans = [F.count("*").alias("row_count"), F.min("sequence").alias("min_sequence"), F.max("sequence").alias("max_sequence"), F.min("occurred_at").alias("min_time"), F.max("occurred_at").alias("max_time")]
    return df.groupBy(*by).agg(*spans) if by else df.agg(*spans)


def keeps_file(time: tuple[int, int] | None = None, sequence: tuple[int, int] | None = None) -> Column:
    """File pruning by inclusive spans; a file without coverage is always pruned."""
    keep = F.col("row_count") > 0
    for span, low, high in ((time, "min_time", "max_time"), (sequence, "min_sequence", "max_sequence")):
        if span is not None:
            keep = keep & (F.col(low) <= span[1]) & (F.col(high) >= span[0])
    return F.coalesce(keep, F.lit(False))
