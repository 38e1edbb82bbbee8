"""Projected scans, column rights, redaction and the context packet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.journal import INTERNAL

REDACTED = "[redacted]"


def projected(df: DataFrame, columns: list[str], granules: list[int] | None = None) -> DataFrame:
    """The asked columns in the asked order. Granules come in the asked order and as often as they
    are asked for; unknown columns and granules are errors."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    if granules is None:
        return df.select(*columns)
    have = {r[0] for r in df.where(F.col("granule_id").isin(*granules)).select("granule_id").distinct().collect()} if granules else set()
    if unknown := [g for g in granules if g not in have]:
        raise ValueError(f"unknown granules {unknown}")
    asked = F.broadcast(df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(granules)], "granule_id long, _asked int"))
    # the plain filter reaches the scan; the list of asked granules is the caller's own
    return df.where(F.col("granule_id").isin(*granules)).join(asked, "granule_id").orderBy("_asked", "row_ordinal").select(*columns)


def family_egress(df: DataFrame, column: str, internal: bool) -> DataFrame:
    """A whole column in row order, for internal jobs only."""
    if not internal:
        raise PermissionError("bulk egress is for internal jobs")
    return df.select("granule_id", "row_ordinal", column).orderBy("row_ordinal")


def row(df: DataFrame, ordinal: int) -> DataFrame:
    return df.where(F.col("row_ordinal") == ordinal)


def granule_rows(df: DataFrame, granule: int) -> DataFrame:
    return df.where(F.col("granule_id") == granule).orderBy("row_ordinal")


def authorize(columns: list[str], schema: list[str], caller: str) -> tuple[list[str], list[str]]:
    """(allowed, dropped) in the asked order. Internal callers get all; others known public columns."""
    if caller == "internal":
        return list(columns), []
    ok = [c in schema and c not in INTERNAL for c in columns]
    return [c for c, k in zip(columns, ok) if k], [c for c, k in zip(columns, ok) if not k]


def redact_fields(df: DataFrame, marks: DataFrame, columns: list[str], raw: str | None = "raw_payload") -> DataFrame:
    """``columns`` are null in the rows that ``marks`` (row_ordinal) names, and the raw payload,
    which holds them all, is withheld whole."""
    hidden = [*columns, *([raw] if raw in df.columns else [])]
    marked = df.join(marks.select("row_ordinal", F.lit(True).alias("_marked")).distinct(), "row_ordinal", "left")
    return marked.select(*[F.when(F.col("_marked"), F.lit(None)).otherwise(F.col(c)).alias(c) if c in hidden else F.col(c) for c in df.columns])


def deidentify(df: DataFrame, subject: str, personal: str) -> DataFrame:
    """Business records without their person: no subject key, every personal field a marker, all
    other columns as they were."""
    return df.withColumn(subject, F.lit(None).cast(df.schema[subject].dataType)).withColumn(personal, F.transform_values(personal, lambda k, v: F.lit(REDACTED)))


#: What a context packet holds; internal ids never.
CONTEXT = ["occurred_at", "event_type", "entity_id", "title", "summary"]


def context_packet(df: DataFrame, columns: list[str] = CONTEXT) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns and c not in INTERNAL])
